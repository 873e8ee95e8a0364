from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", 4, "tickloom-tests")


@pytest.fixture(scope="session")
def calendar(spark):
    from tickloom.operators.calendar import pinned

    return pinned(spark)
