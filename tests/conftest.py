from __future__ import annotations

import pytest

from casework.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 8, 8)
    yield session
    session.stop()
