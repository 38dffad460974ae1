import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pointline.session import local_session  # noqa: E402

LEDGER = "id bigint, ts string, player_id bigint, action string, points bigint, kind string"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "pointline-tests")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger from ``(id, ts, player_id, action, points[, kind])`` tuples."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(*r, "action")[:6] for r in rows]
        frame = spark.createDataFrame(full, LEDGER)
        return frame.withColumns({
            "ts": F.col("ts").cast("timestamp_ntz"),
            "category": F.when(F.col("action").contains("sport"), "sport").when(
                F.col("action").contains("school"), "academic").otherwise("unknown"),
            "actor": F.lit("x")})
    return make


@pytest.fixture(scope="session")
def make_players(spark):
    def make(rows):
        return spark.createDataFrame(rows, "player_id bigint, name string, team string")
    return make


def rows_of(frame, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r) for r in (frame.select(*columns) if columns else frame).collect())
