import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path[:0] = [ROOT, str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from presflow.session import get_session, importable

    session = get_session("tests", os.environ.get("TEST_MASTER", "local[4]"), **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/presflow-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield importable(session)
    session.stop()
