from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge table, stored."""
    from helpers import stored

    return stored(spark, tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """Empty tables, stored."""
    from helpers import stored

    return stored(spark, tmp_path_factory.mktemp("none"), which=[])
