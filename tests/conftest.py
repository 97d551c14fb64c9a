import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from memjoin.session import local_session

    session = local_session("4", 4, "memjoin-tests")
    yield session
    session.stop()
