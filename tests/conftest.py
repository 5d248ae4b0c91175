from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tallyline.session import build_session

    session = build_session(app="tests", cores="4", shuffle_partitions=4, **{"spark.driver.memory": "3g"})
    yield session
    session.stop()
