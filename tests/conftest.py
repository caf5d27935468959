import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(
    [sys.path[0], os.environ.get("PYTHONPATH", "")])

from channel_signals.session import HOT_ROWS_CONF, SLICE_ROWS_CONF, get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", cores="8", spark__sql__shuffle__partitions="4")


@pytest.fixture
def tiny_tasks(spark):
    """Thresholds so low that every key is hot and every order is sliced."""
    spark.conf.set(HOT_ROWS_CONF, "2")
    spark.conf.set(SLICE_ROWS_CONF, "3")
    yield spark
    spark.conf.unset(HOT_ROWS_CONF)
    spark.conf.unset(SLICE_ROWS_CONF)
