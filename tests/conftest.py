import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from peerwatch.session import local_session
    from peerwatch.sources.staging import drop_stages

    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    drop_stages(session)
    session.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="peerwatch-test-")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


def months(spark, rows):
    """Monthly fact from (entity, 'yyyy-mm', total, cancelled) tuples."""
    from peerwatch import schemas
    from datetime import date

    def day(text):
        return None if text is None else date(int(text[:4]), int(text[5:7]), 1)

    data = [(e, day(m), t, c, t - c, 0) for e, m, t, c in rows]
    return spark.createDataFrame(data, schemas.MONTHLY_FACT)
