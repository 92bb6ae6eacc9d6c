"""The stream whose state ends, against a loop over its batches."""

import datetime

from airloom.streaming.ended import ended_batch, ended_rows, run_until_silent
from airloom.streaming.live import EVENTS

START = datetime.datetime(2024, 1, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def write(spark, folder, batches):
    """One file a batch, read in the order of their times."""
    import os

    for i, rows in enumerate(batches):
        path = folder / f"batch{i}"
        spark.createDataFrame([(n, t, u, "kind", v, None) for n, t, u, v in rows], EVENTS).coalesce(1).write.parquet(str(path))
        file = next(path.glob("part-*.parquet"))
        target = folder / f"events{i}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)


def loop(batches, idle, delay):
    """Rows put out, events dropped and entities left, batch by batch."""
    mark = before = datetime.datetime.min
    state, out, late = {}, [], 0
    for rows in [*batches, []]:
        for n, t, u, v in rows:
            if t <= before:  # late is what lies behind the mark of the batch before
                late += 1
                continue
            old = state.get(u, (None, None, None, 0))
            best = max([x for x in (old[:3], (t, n, v)) if x[0] is not None])
            state[u] = (*best, old[3] + 1)
        for u in [u for u, s in state.items() if s[0] + idle <= mark]:
            out.append((str(u), state[u][0].strftime("%Y-%m-%d %H:%M:%S"), state[u][2], state.pop(u)[3]))
        before = mark
        mark = max([mark, *[t - delay for _, t, _, _ in rows]])
    return sorted(out), late, len(state)


def test_late_events_and_silent_entities(spark, tmp_path):
    batches = [
        [(1, at(0), 7, 10.0), (2, at(1), 7, 20.0), (3, at(5), 8, 120.0), (4, at(5), 8, 130.0)],
        [(6, at(6), 8, 210.0), (7, at(60), 9, 40.0)],
        # entities 7 and 8 end; event 5 comes late and is dropped
        [(5, at(2), 7, 999.0), (10, at(61), 9, 45.0)],
        # entity 7 comes back after its end
        [(8, at(62), 7, 60.0), (9, at(500), 1, 1.0)],
    ]
    write(spark, tmp_path, batches)
    got = run_until_silent(spark, str(tmp_path), idle="24 hours", delay="1 hour", pattern="events*.parquet", files=1)
    rows, late, open_ = loop(batches, datetime.timedelta(hours=24), datetime.timedelta(hours=1))
    shown = sorted((r.entity, r.time, r.value, r.events) for r in ended_rows(got.rows).collect())
    assert shown == rows and len(rows) == 4 and {r[0] for r in rows} == {"7", "8", "9"}
    assert got.late == late == 1
    # only the entity that spoke last is still open: its row and its timer
    assert open_ == 1 and got.open <= 3
    assert {r.category for r in ended_rows(got.rows).collect()} >= {"Good"}


def test_a_stream_equals_its_batch_twin(spark):
    from tests.conftest import SMALL

    got = run_until_silent(spark, SMALL, idle="2 days", delay="1 hour", pattern="events.parquet")
    want = ended_batch(spark.read.parquet(f"{SMALL}/events.parquet"), idle="2 days").collect()
    assert sorted(map(tuple, ended_rows(got.rows).collect())) == sorted(map(tuple, want)) and got.late == 0


def test_no_state_is_left_when_all_have_ended(spark):
    from tests.conftest import SMALL

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    got = run_until_silent(spark, SMALL, idle="0 hours", delay="0 seconds", pattern="events.parquet")
    assert got.open == 0 and got.rows.count() == events.select("user_id").distinct().count()
