import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sitegraph.session import get_session

    # tests own their checkpoint folder; a cluster names it in spark.checkpoint.dir
    ckpt = tempfile.mkdtemp(prefix="sitegraph-test-ckpt-")
    s = get_session(master="local[*]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "8g"})
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from oracle_harness import duck

    return duck(SF_SMALL)
