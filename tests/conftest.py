import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from linkatlas.session import local_session  # noqa: E402


# Columns at module level need the session to be there.
SESSION = local_session(8, "linkatlas-tests")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
