"""One small local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import build_session

    return build_session("4", partitions=4)


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every stats table is too large to broadcast and every key is hot."""
    from sparkloom import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(shared, "HOT_PARTS", 1_000_000)
    monkeypatch.setattr(shared, "SALTS", 3)
