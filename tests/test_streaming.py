"""Runs of observations on a stream against a plain replay, cut anywhere, repeated and restarted."""

import random

import pytest

from fundsieve.streaming import reconcile as stream


def replay(runs):
    """The state and events of runs [(date, source, id, listings)] applied one after the other."""
    state, events = {}, []
    status = lambda: {k[0]: "active" if any(v[1] == "active" for j, v in state.items() if j[0] == k[0]) else "inactive" for k in state}
    for date, source, run, seen in sorted(runs):
        before, old = dict(state), status()
        for k in state:
            if k not in seen and state[k][0] == source:
                state[k] = (source, "inactive")
        for k in seen:
            state[k] = (source, "active")
        for kind, was, now in (("listing", {k: v[1] for k, v in before.items()}, {k: v[1] for k, v in state.items()}), ("instrument", old, status())):
            for k, s in now.items():
                if was.get(k) != s:
                    key = k if kind == "listing" else (k, None, None)
                    events.append((kind, *key, was.get(k), s, "deactivated" if s == "inactive" else "reactivated" if k in was else "inserted", run, source, date))
    return sorted((*k, *v) for k, v in state.items()), sorted(events, key=repr)


def rows_of(run):
    date, source, name, seen = run
    return [(name, source, date, *k, None) for k in seen] + [(name, source, date, None, None, None, len(seen))]


def made(rnd, n):
    keys = [(f"I{i}", v, "T") for i in range(6) for v in ("X", "Y")]
    return [(f"2026-01-{d + 1:02}", s, f"r{d}{s}", rnd.sample(keys, rnd.randint(0, 7))) for d in range(n) for s in "ab" if rnd.random() < 0.8]


def result(spark, path):
    state = sorted(map(tuple, stream.current(spark, path).collect()))
    return state, sorted(map(tuple, stream.events_so_far(spark, path).collect()), key=repr)


def land(spark, rows, path):
    spark.createDataFrame(rows, stream.OBSERVATIONS).coalesce(1).write.mode("append").parquet(f"{path}/in")


def go(spark, path):
    source = spark.readStream.schema(stream.OBSERVATIONS).parquet(f"{path}/in")
    stream.reconcile_stream(source, f"{path}/out", f"{path}/checkpoint").awaitTermination()


@pytest.mark.parametrize("seed", range(4))
def test_a_timeline_equals_a_replay(spark, seed):
    rnd = random.Random(seed)
    runs = made(rnd, 6)
    half = sorted(runs)[: len(runs) // 2]
    listing = spark.createDataFrame(replay(half)[0], stream.STATE)
    later = [r for r in runs if r not in half]
    seen = spark.createDataFrame([(r[2], *k) for r in later for k in r[3]], "run_id string, isin string, venue_mic string, ticker string")
    table = spark.createDataFrame([r[:3] for r in later], "asof_date string, source_name string, run_id string")
    after, events = stream.timeline(listing, seen, table)
    state, told = replay(runs)
    assert sorted(map(tuple, after.collect())) == state
    known = replay(half)[1]
    assert sorted(map(tuple, events.collect()), key=repr) == [e for e in told if e not in known]


def test_runs_that_span_batches_apply_once_and_whole(spark, tmp_path):
    rnd = random.Random(11)
    runs = made(rnd, 5)
    rows = [x for r in sorted(runs) for x in rows_of(r)]
    # neighbours change places, some rows come twice, and cuts lie within runs
    for i in range(0, len(rows) - 1, 3):
        rows[i], rows[i + 1] = rows[i + 1], rows[i]
    rows += rnd.sample(rows, 6)
    for at in range(0, len(rows), 13):
        land(spark, rows[at : at + 13], tmp_path)
        go(spark, tmp_path)
    assert result(spark, f"{tmp_path}/out") == replay(runs)


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    runs = made(random.Random(12), 4)
    rows = [x for r in sorted(runs) for x in rows_of(r)]
    real, fail = stream.timeline, [True]

    def timeline(*args):
        after, events = real(*args)
        if fail[0]:  # the state is written, its events are not
            after.write.mode("overwrite").parquet(f"{tmp_path}/out/state/0")
            raise RuntimeError("killed")
        return after, events

    monkeypatch.setattr(stream, "timeline", timeline)
    land(spark, rows[:-3], tmp_path)
    with pytest.raises(Exception, match="killed"):
        go(spark, tmp_path)
    assert result(spark, f"{tmp_path}/out") == ([], [])
    fail[0] = False
    go(spark, tmp_path)
    land(spark, rows[-3:], tmp_path)
    go(spark, tmp_path)
    assert result(spark, f"{tmp_path}/out") == replay(runs)


def test_open_runs_hold_later_ones_back(spark, tmp_path):
    one, two = ("2026-01-01", "a", "r1", [("I", "X", "T")]), ("2026-01-02", "a", "r2", [])
    land(spark, rows_of(one)[:1] + rows_of(two) + [(None, "a", "2026-01-01", "J", "X", "T", None)], tmp_path)
    go(spark, tmp_path)
    assert result(spark, f"{tmp_path}/out") == ([], [])
    land(spark, rows_of(one)[1:], tmp_path)
    go(spark, tmp_path)
    assert result(spark, f"{tmp_path}/out") == replay([one, two])
