from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import local_session, ship

    session = local_session(4, partitions=4, memory="4g")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
