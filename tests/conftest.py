import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("COHORTLAB_SCRATCH", tempfile.mkdtemp(prefix="cohortlab-test-"))
    from cohortlab.session import get_session

    s = get_session(cores=4, shuffle_partitions=8, app="cohortlab-tests")
    yield s
    s.stop()
