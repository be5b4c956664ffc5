import sys
import tempfile

import pytest

from paths import ROOT, SF_SMALL

if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from revlens.session import build_session
    s = build_session("local[4]", shuffle_partitions=4)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="revlens-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from revlens.sources.adapters import load_tables
    return load_tables(spark, SF_SMALL)


@pytest.fixture()
def multi_bucket(spark):
    """Deal the rows of ordering operators out to many small partitions."""
    spark.conf.set("revlens.order.partitions", "23")
    spark.conf.set("revlens.select.every", "7")
    yield
    spark.conf.unset("revlens.order.partitions")
    spark.conf.unset("revlens.select.every")
