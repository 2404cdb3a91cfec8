import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pulse.session import ensure_test_checkpoint_dir, local_session
    s = local_session(4, shuffle_partitions=8, app="pulse-tests")
    ensure_test_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
