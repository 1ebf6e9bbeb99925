import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomspace.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(cores=4, memory="4g", partitions=4))
    yield session
    session.stop()
