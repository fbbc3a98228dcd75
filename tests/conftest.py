import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import local_session, shared_dir

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL
