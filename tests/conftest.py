from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from assetflow.session import local_session  # noqa: E402
from assetflow.streaming.watch import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", spark__sql__streaming__stateStore__providerClass=ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture
def small_groups(spark):
    """Treat groups of more than three rows as too big for a task."""
    spark.conf.set("assetflow.group.rows", "3")
    yield
    spark.conf.unset("assetflow.group.rows")
