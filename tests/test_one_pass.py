"""Runs at the end of a history from one pass over the snapshots, equal to the plain walk."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import features as fe, journey as jo

T0 = dt.datetime(2020, 1, 1)


def history(spark, path):
    rng, rows = random.Random(2), []
    for c in range(40):
        status = "active"
        for k in range(rng.randint(1, 30)):
            status = status if rng.random() < 0.8 else rng.choice(["active", "dormant", "churn_risk"])
            rows.append((c, T0 + dt.timedelta(days=7 * k), status))
    spark.createDataFrame(rows + [(None, T0, "churn_risk")], "customer_id long, snapshot_date timestamp_ntz, current_status string").write.parquet(path)
    return rows, spark.read.parquet(path)


def last_run(rows):
    out = {}
    for c, t, s in rows:
        if c not in out or out[c][0] != s:
            out[c] = (s, t)
        out[c] = (*out[c][:2], t)
    return out


def scans(df):
    return sum("Relation [" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_final_run_and_stage_equal_the_plain_walk_and_read_once(spark, tmp_path):
    rows, snapshots = history(spark, str(tmp_path / "s"))
    want = last_run(rows)
    run = jo.final_churn_run(snapshots)
    assert {tuple(r) for r in run.collect()} == {(c, a, b) for c, (s, a, b) in want.items() if s == "churn_risk"} and scans(run) == 1
    # the snapshots are not computed and written for it, however costly they are
    twice = jo.final_churn_run(snapshots.where(F.col("snapshot_date") >= T0))
    assert str(tmp_path / "s").rstrip("/") in twice.inputFiles()[0]
    stage = fe.journey_stage(snapshots, "2030-01-01 00:00:00")
    assert {(r.customer_id, r.current_journey_stage, r.journey_stage_days) for r in stage.collect()} == {(c, s, (b - a).days + 1) for c, (s, a, b) in want.items()}
    assert scans(stage) == 1 and str(tmp_path / "s") in stage.inputFiles()[0]
