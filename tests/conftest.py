import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tollgate.session import build_session

    s = build_session("local[4]", app="tollgate-tests", shuffle_partitions=4)
    # Tests own their scratch space when the session names none; a cluster
    # names a shared folder in spark.checkpoint.dir instead.
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tollgate-tests-"))
    yield s
    s.stop()
