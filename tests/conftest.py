import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from condense.session import local_session

    session = local_session(8, "condense-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
