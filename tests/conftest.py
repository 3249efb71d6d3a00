import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from specframe.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "tests")
    yield session
    session.stop()
