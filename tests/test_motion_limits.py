"""Classes of motion on their limits, and of motions that a matrix doesn't give back, are those of the SQL."""

import random

import duckdb
import pytest

from cadence.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def shots(spark, tmp_path_factory):
    r, rows = random.Random(8), []
    for shot in range(400):
        luma = [round(r.uniform(0, 500), 2) for _ in range(2)]
        luma[1] = round(luma[0] + r.uniform(-20, 20), 2)
        # 40 from the frame before last is a zoom of just 0.002; 10 and 0, 6 and 16, 8 and 12 are pans of just 0.5
        for step in range(12):
            luma.append(round(luma[-2] + 40 * (-1) ** (step % 3), 2) if shot % 2 else round(luma[-1] + r.choice([10, -10, 6, -8, 8]), 2))
        rows += [(shot, x) for x in luma]
    odd = [0.0, 1e4, -1e6, 3e5, -12566.37, 12566.38, 0.0, -2e4, -2e4, -2e4, 1e300, 0.0, float("nan"), 1.0, 2.0, 3.0, float("inf"), float("inf"), 3.0, 4.0, 5.0, None, 6.0, 7.0, 8.0]
    rows += [(400, x) for x in odd]
    path = str(tmp_path_factory.mktemp("shots"))
    events = spark.createDataFrame([(i, shot, "click", x) for i, (shot, x) in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    events.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["f8_motion_class", "a15_dominant_motion"])
def test_kinds_on_limits(spark, shots, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{shots}/events.parquet/*.parquet'")
    got, want = sorted(map(tuple, QUERIES[name](spark, shots).collect())), sorted(duck.sql(ORACLES[name]).fetchall())
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []
    assert name.startswith("a15") or {k for *_, k in want} == {"rotation", "zoom", "pan", "static"}
