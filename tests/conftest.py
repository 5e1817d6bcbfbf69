import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cataloom.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # a private checkpoint folder only because the test session has none
    ckpt = tempfile.mkdtemp(prefix="cataloom-test-ckpt-")
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="cataloom-tests",
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
