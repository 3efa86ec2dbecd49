"""Row-count windows on a stream: the state's arithmetic, and compacted logs."""
import datetime as dt
import random

import pytest

from grovecast.functions.rules import RAINY_DAY_MM
from grovecast.streaming import jobs, rows

DAY = dt.date(2020, 1, 1)


def plain(all_rows, n):
    order = sorted(all_rows)
    out = {}
    for k, d in enumerate(order):
        w = [all_rows[x] for x in order[max(0, k - n + 1):k + 1]]
        temps = [r[1] for r in w if r[1] is not None]
        out[d] = (len(w), sum(temps) / len(temps) if temps else None, sum(r[2] for r in w if r[2] is not None),
                  sum(r[2] is not None and r[2] > RAINY_DAY_MM for r in w))
    return out


def random_row(rng, k):
    return (DAY + dt.timedelta(days=k), rng.choice([None, rng.randrange(300) / 10]), rng.choice([None, rng.randrange(40) / 10]), 50.0)


@pytest.mark.parametrize("seed", range(8))
def test_late_rows_within_the_horizon_give_the_batch_result(seed):
    """Rows with gaps, in any order within the horizon, some of them corrected."""
    rng, n, horizon = random.Random(seed), 5, 20
    kept, held, cut, seen = {}, [], False, {}
    at = 0
    for _ in range(60):
        at += rng.randrange(1, 5)
        batch = [random_row(rng, max(0, at - rng.randrange(0, horizon - 5))) for _ in range(rng.randrange(1, 4))] + [random_row(rng, at)]
        batch = list({r[0]: r for r in batch}.values())
        held, cut, out = rows.place(held, cut, batch, n, horizon)
        kept |= {r[0]: r for r in batch}
        seen |= {r[0]: r for r in out}
        assert len(held) <= horizon + 1 + n - 1
    want = plain(kept, n)
    assert set(seen) == set(want)
    for d, (k, temp, rain, rainy) in want.items():
        got = seen[d]
        assert got[1] == k and got[5] == rainy and got[3] == pytest.approx(rain)
        assert got[2] == (None if temp is None else pytest.approx(temp))


def test_rows_behind_the_state_are_dropped():
    rng = random.Random(1)
    held, cut, _ = rows.place([], False, [random_row(rng, k) for k in range(100)], 5, 20)
    assert cut and len(held) == 21 + 4
    again, _, out = rows.place(held, cut, [random_row(rng, 10)], 5, 20)
    assert again == held and out == []
    assert rows.place([], False, [], 5, 20) == ([], False, [])


def test_compacted_log_reads_the_same(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    schema = "site string, obs_date int, v int"
    for b, data in enumerate([[("A", 1, 10), ("A", 2, 10)], [("A", 2, 20), ("B", 1, 20)], [("A", 2, 30)]]):
        spark.createDataFrame(data, schema).write.parquet(f"{log}/batch_id={b}")
        if b == 1:
            assert rows.compact_log(spark, log, ["site", "obs_date"]) == 1
            assert rows.compact_log(spark, log, ["site", "obs_date"]) == 1  # nothing new
    spark.createDataFrame([("A", 1, 99)], schema).write.parquet(f"{log}-compacted/upto=7/part")  # not complete
    got = {(r["site"], r["obs_date"]): r["v"] for r in rows.read_log(spark, log, ["site", "obs_date"]).collect()}
    plain_log = jobs.latest_versions(spark.read.parquet(log), ["site", "obs_date"])
    assert got == {("A", 1): 10, ("A", 2): 30, ("B", 1): 20} == {(r["site"], r["obs_date"]): r["v"] for r in plain_log.collect()}
