"""The reclustering chain against a plain model of its rules."""

import numpy as np
from pyspark.sql import functions as F

from presflow.operators import clustering as C

UNIT = lambda v: v / np.linalg.norm(v)


def plain(samples, eps, least, must, cannot, named, bank, sim, margin):
    """members {track: cluster}, names {cluster: name}: density clusters, cannot before must, mean of faces, open-set names."""
    tracks = sorted({t for t, _ in samples})
    centre = {t: UNIT(np.mean([v for s, v in samples if s == t], axis=0)) for t in tracks}
    near = {t: {s for s in tracks if centre[t] @ centre[s] >= 1 - eps} for t in tracks}
    core = [t for t in tracks if len(near[t]) >= least]
    label, n = {}, 0
    for t in core:
        if t in label:
            continue
        todo = [t]
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = n
            todo += [y for y in near[x] if x in core]
        n += 1
    clusters = {c: [t for t in tracks if label.get(t) == c] for c in range(n)}
    means = {c: np.mean([v for t, v in samples if t in some], axis=0) for c, some in clusters.items()}
    by_hand = {t: name for c, some in sorted(named.items()) for t in some[2] if some[0] and some[0] != "Unknown" and some[1] in (None, 1.0) for name in [some[0]]}
    pairs = {tuple(sorted(p)) for p in cannot} | {(a, b) for a in by_hand for b in by_hand if a < b and by_hand[a] != by_hand[b]}
    ties = {tuple(sorted(p)) for p in must}
    for name, conf, some in named.values():
        if name and conf in (None, 1.0):
            ties |= {(a, b) for a in some for b in some if a < b}
    for name in {x[0] for x in named.values() if x[0] and x[1] == 1.0}:
        every = [t for x in named.values() if x[0] == name and x[1] == 1.0 for t in x[2]]
        ties |= {(a, b) for a in every for b in every if a < b and (a, b) not in {tuple(sorted(p)) for p in cannot}}
    group = {t: t for pair in ties for t in pair}
    for _ in range(len(group)):
        for a, b in ties:
            group[a] = group[b] = min(group[a], group[b])
    fresh = n
    for c in range(n):
        bad = {t for t in clusters[c] for s in clusters[c] if tuple(sorted((t, s))) in pairs}
        if bad:
            clusters[fresh], means[fresh] = sorted(bad), means[c]
            clusters[c] = [t for t in clusters[c] if t not in bad]
            fresh += 1
    clusters = {c: some for c, some in clusters.items() if some}
    final = {}
    for comp in {group.get(min(some)) for some in clusters.values()}:
        parts = [c for c, some in clusters.items() if group.get(min(some)) == comp]
        for some in [parts] if comp is not None else [[c] for c in parts]:
            final[min(some)] = (sorted(t for c in some for t in clusters[c]), UNIT(np.mean([means[c] for c in some], axis=0)))
    names = {}
    for c, (_, v) in final.items():
        scores = sorted(((max(v @ UNIT(x) for x in protos), name) for name, protos in bank.items()), reverse=True)
        second = scores[1][0] if len(scores) > 1 else 0.0
        names[c] = scores[0][1] if scores[0][0] >= sim and scores[0][0] - second >= margin else None
    return {t: c for c, (some, _) in final.items() for t in some}, names, {c: v for c, (_, v) in final.items()}


def check(spark, faces, must, cannot, named, bank):
    rows, refs, n = [], [], 0
    for t, some in faces.items():
        for v in some:
            rows.append((n, n, 0, 10, 10, 110, 110, 0.9, v))
            refs.append((t, n, n, 0))
            n += 1
    detections = spark.createDataFrame(rows, "vec_id bigint, frame_id bigint, det_idx int, x1 int, y1 int, x2 int, y2 int, conf double, embedding array<double>")
    links = spark.createDataFrame([("must", *p) for p in must] + [("cannot", *p) for p in cannot], "kind string, a bigint, b bigint")
    old = spark.createDataFrame([(c, t, name, conf) for c, (name, conf, some) in named.items() for t in some], "cluster_id bigint, track_id bigint, name string, confidence double")
    protos = spark.createDataFrame([(name, 100 * i + j, v) for i, (name, some) in enumerate(bank.items()) for j, v in enumerate(some)], "identity string, proto_id bigint, embedding array<double>")
    params = C.ReclusterParams(eps=0.05, faces=20, least_conf=0.5, least_size=50, open_sim=0.6, open_margin=0.05, sweep=C.SweepParams(least=2))
    out = C.recluster(detections, spark.createDataFrame(refs, "track_id bigint, ord int, frame_id bigint, det_idx int"), protos, spark.createDataFrame([(77,)], "track_id bigint"), links, F.col("conf"), params, old)
    members, names, centres = plain([(t, np.array(v)) for t, some in faces.items() if t != 77 for v in some], 0.05, 2, must, cannot, named, bank, 0.6, 0.05)
    got = out["members"].collect()
    assert {r.track_id: r.cluster_id for r in got} == members
    assert {r.cluster_id: r.name for r in got} == names
    for r in out["centres"].collect():
        assert np.allclose(r.centroid, centres[r.cluster_id])
    return out, members, names


def at(*degrees):
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d))), 0.1] for d in degrees]


def test_cannot_links_before_must_links(spark):
    faces = {1: at(0, 1, 2), 2: at(3, 4), 3: at(5), 4: at(60, 61), 5: at(62, 60, 58, 59), 6: at(63), 7: at(120, 121), 8: at(122), 9: at(123, 119), 10: at(200), 77: at(1)}
    bank = {"ANN": at(2), "BEA": at(60, 70), "CLEO": at(125)}
    out, members, _ = check(spark, faces, [(2, 4)], [(2, 3)], {}, bank)
    assert 10 not in members and 77 not in members  # noise, and suppressed
    assert members[1] != members[2] == members[3] == members[4] == members[6]  # the two leave, and are tied to the next cluster
    assert {r.label: r.size for r in out["figures"].collect()} == {0: 3, 1: 3, 2: 3}
    assert out["persons"].count() >= 1 and out["clusters"].count() == len(set(members.values()))


def test_names_given_by_hand(spark):
    faces = {t: at(*range(10 * (t % 3) * 4 + t, 10 * (t % 3) * 4 + t + 2 + t % 4)) for t in range(1, 13)}
    bank = {"ANN": at(5), "BEA": at(45), "CLEO": at(90)}
    # ANN twice by hand, BEA by hand within a cluster of others, CLEO only by the machine
    named = {0: ("ANN", 1.0, [3, 6]), 1: ("ANN", 1.0, [1, 4]), 2: ("BEA", 1.0, [9]), 3: ("CLEO", 0.8, [2, 5]), 4: ("BEA", 1.0, [8]), 5: (None, None, [11]), 6: ("Unknown", 1.0, [12])}
    check(spark, faces, [], [(8, 9)], named, bank)
    check(spark, faces, [(2, 12)], [(1, 4)], named, bank)
