"""Assembled uploads against hashlib, and clean clusters with a planted intruder."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from presflow.operators import clustering as C
from presflow.operators import logs
from presflow.operators.recovery import contamination_audit
from presflow.operators.summaries import workspace_counts


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_assembled_uploads(spark):
    rng = random.Random(2)
    long = [rng.randbytes(20_000) for _ in range(300)]
    uploads = [("long", 300, sha(b"".join(long)).upper()), ("long", 300, sha(b"".join(long)).upper()), ("short", 3, sha(b"abc")), ("wrong", 1, sha(b"x")), ("none", 2, sha(b"ab")), ("empty", 0, None), ("untold", 2, None), (None, 1, None), ("odd", None, sha(b"z"))]
    received = [("long", i, 0, d) for i, d in enumerate(long)] + [("short", 2, 0, b"c"), ("short", 0, 0, b"zz"), ("short", 0, 9, b"a"), ("short", 0, None, b"zzz"), ("short", 1, 0, b"b"), ("short", 1, 0, b"b"), ("short", 3, 0, b"beyond"), ("short", -1, 0, b"before")]
    received += [("wrong", 0, 0, b"y"), ("none", 1, 0, b"b"), ("untold", 0, 0, None), ("untold", 1, 0, b"q"), ("stranger", 0, 0, b"q"), (None, 0, 0, b"q")]
    rng.shuffle(received)
    u = spark.createDataFrame(uploads, "upload_id string, chunks int, sha256 string")
    r = spark.createDataFrame(received, "upload_id string, chunk int, at int, data binary").repartition(5)
    got = {x.upload_id: (x.n_bytes, x.sha256, x.status) for x in logs.assembled(u, r).collect()}
    assert got == {
        "long": (6_000_000, sha(b"".join(long)), "ok"), "short": (3, sha(b"abc"), "ok"), "wrong": (1, sha(b"y"), "mismatch"), "none": (None, None, "missing"),
        "empty": (0, sha(b""), "ok"), "untold": (1, sha(b"q"), "ok"), "odd": (0, sha(b""), "mismatch"),
    }
    assert logs.assembled(u.limit(0), r).count() == 0 and {x.status for x in logs.assembled(u, r.limit(0)).collect()} == {"missing", "ok", "mismatch"}


def test_clean_clusters(spark):
    """Two people, three tracks each; one track of the first turns into the second for five faces, one face is too small, one is covered."""
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    faces, n = [], 0
    for track in range(6):
        for i in range(16):
            angle = (0 if track < 3 else 80) + track + i / 10
            if track == 2 and i >= 11:
                angle = 80
            small = track == 0 and i == 3
            faces.append((n, n, 0, track, 0, 0, 40 if small else 90, 40 if small else 90, 0.9, at(angle)))
            n += 1
    faces.append((n, 20, 1, 6, 5, 5, 95, 95, 0.9, at(10)))  # covers frame 20, and is covered by it
    faces.append((n + 1, n + 1, 0, 7, 0, 0, 90, 90, 0.9, None))
    df = spark.createDataFrame(faces, "vec_id bigint, frame_id bigint, det_idx int, track_id bigint, x1 int, y1 int, x2 int, y2 int, conf double, embedding array<double>")
    refs = df.select("frame_id", "det_idx", "track_id")
    made = C.clean_clusters(df, refs, F.lit(1.0), C.CleanParams(faces=16))
    samples = {(r.track_id, r.vec_id): r["at"] for r in made["samples"].collect()}
    assert (0, 3) not in samples and (1, 20) not in samples and not {t for t, _ in samples} & {6, 7} and samples[(0, 4)] == 3
    clusters = {}
    for r in made["members"].collect():
        clusters.setdefault(r.cluster_id, set()).add(r.track_id)
    assert sorted(map(sorted, clusters.values())) == [[0, 1, 2], [3, 4, 5]]
    home, away = (next(c for c, some in clusters.items() if t in some) for t in (0, 3))
    spans = [(r.cluster_id, r.track_id, r.first_at, r.last_at, r.n, r.reason, r.action) for r in made["spans"].collect()]
    assert spans == [(home, 2, 11, 15, 5, "cross_identity", f"split_to_{away}")]
    assert sorted((r.label, r.size) for r in made["figures"].collect()) == [(home, 3), (away, 3)]
    assert C.clean_clusters(df.limit(0), refs.limit(0), F.lit(1.0))["members"].count() == 0


def test_audit_split_to_the_best_that_there_is(spark):
    """The sample with the largest margin is unlike every other cluster, so the split is to the cluster that its neighbour is like."""
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(0, 0, i, i, at(0)) for i in range(8)] + [(0, 0, 8, 8, at(200)), (0, 0, 9, 9, at(70))] + [(1, 1, i, 20 + i, at(80)) for i in range(3)]
    faces = spark.createDataFrame(rows, "cluster_id bigint, track_id bigint, at bigint, vec_id bigint, embedding array<double>")
    (span,) = contamination_audit(faces, -2.0, 1e9, 0.5, 2, 0.5).collect()
    assert (span.first_at, span.last_at, span.n, span.reason, span.other, span.action) == (8, 9, 2, "cross_identity", 1, "split_to_1")
    assert abs(span.strength + math.cos(math.radians(200))) < 1e-9


def test_low_confidence_in_order_of_tracks(spark):
    """Clusters whose mean is the limit but for the last digit: sums in order of tracks decide, however rows are dealt."""
    rng, rows, low = random.Random(3), [], 0
    for cluster in range(200):
        parts = rng.sample(range(25), 8)
        confs = [0.5 + k / 100.0 for p in parts for k in (24 - p, 24 + p)]
        rng.shuffle(confs)
        total = 0.0
        for i, c in enumerate(confs):
            total += c
            rows.append((cluster, 100 * cluster + i, "p", False, c))
        low += total / len(confs) < 0.74
    assert 0 < low < 200
    df = spark.createDataFrame(rows, "cluster_id bigint, track_id bigint, person string, dirty boolean, confidence double")
    for parts in (3, 7):
        got = workspace_counts(df.orderBy(F.rand(parts)).repartition(parts), 0.74).first()
        assert (got.clusters, got.low_confidence, got.tracks) == (200, low, len(rows))
