import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from textlake.session import local, ship

    session = local("4", 4)
    ship(session)
    yield session
    session.stop()
