import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session

    session = get_session("tests", cores="8", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
