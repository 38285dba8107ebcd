"""Sessions that end when idle, against the same rule over all rows at once."""

import datetime as dt
import itertools

import numpy as np

from newsloom.streaming import expiry as E
from newsloom.streaming import incremental as I

MINUTE = 60_000_000


def brute(ts, seq, idle, limit):
    rows, out = sorted(zip(ts, seq)), []
    for t, s in rows:
        if out and t - out[-1][-1][0] <= idle:
            out[-1].append((t, s))
        else:
            out.append([(t, s)])
    return [(r[0][0], r[-1][0], len(r), [t for t, _ in r[-limit:]], [s for _, s in r[-limit:]]) for r in out]


def test_runs_do_not_depend_on_order_or_pieces():
    draw = np.random.default_rng(5)
    for n, limit in itertools.product((1, 2, 40), (1, 3, 50)):
        ts, seq = draw.integers(0, 600, n) * MINUTE, draw.integers(0, 9, n)
        want = brute(ts.tolist(), seq.tolist(), 30 * MINUTE, limit)
        runs = []
        for part in np.array_split(draw.permutation(n), 4):
            runs = E.merged_runs(runs + E.runs_of(ts[part], seq[part], 30 * MINUTE, limit), 30 * MINUTE, limit)
        assert runs == want
    assert E.runs_of(np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 1) == []


def test_timers_end_sessions_across_restarts(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    parts = [
        [("a", 1, at(0)), ("a", 2, at(30)), ("b", 1, at(5)), (None, 1, at(5)), ("b", 2, None)],
        [("a", 3, at(58)), ("c", 1, at(70))],          # joins the run of the first part
        [("c", 2, at(200))],                           # ends a and b, and the first run of c
        [],
    ]
    for part in parts:
        rows = spark.createDataFrame(part, "session_id string, seq long, ts timestamp").coalesce(1)
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        files = I.table_stream(spark, f"{tmp_path}/in", rows.schema, files_per_batch=100)
        E.run_expiry(files, f"{tmp_path}/out", f"{tmp_path}/progress", limit=2)
    got = spark.read.schema(E.ENDED).parquet(f"{tmp_path}/out").collect()
    assert sorted((r["session_id"], r["messages"], r["started"], r["last_active"], r["kept"]) for r in got) == [
        ("a", 3, at(0), at(58), [2, 3]), ("b", 1, at(5), at(5), [1]), ("c", 1, at(70), at(70), [1])]
    assert spark.conf.get(E.PROVIDER) != E.ROCKS
