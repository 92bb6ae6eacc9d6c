"""Kept monthly partials against a full run, and which files a refresh writes."""

import datetime
import os

from pyspark.sql import functions as F

from airloom.sources.rollups import MONTH, MonthlyPartials, changed_months

DAY = datetime.date(2020, 1, 1)


def files(folder):
    return {d: sorted(f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in os.listdir(folder) if d.startswith(MONTH)}


def test_a_refresh_writes_the_touched_months_only(spark, tmp_path):
    rows = [(c, DAY + datetime.timedelta(days=d), None if (c + d) % 7 == 0 else float(c * d % 31)) for c in range(5) for d in range(300)]
    schema, folder = "city_id int, date date, v double", str(tmp_path / "store")
    before = [r for r in rows if not (r[0] == 1 and r[1].month == 3 or r[0] == 4 and r[1].month == 9 and r[1].day > 10)]
    store = MonthlyPartials(spark, folder, ["city_id"], ["v"])
    store.build(spark.createDataFrame(before, schema))
    old = files(folder)
    now = [r for r in rows if not (r[0] == 2 and r[1].month == 9)] + [(9, datetime.date(2021, 5, 5), 2.5)]  # added, deleted, a new month
    table = spark.createDataFrame(now, schema)
    changes = spark.createDataFrame(sorted(set(now) ^ set(before), key=str), schema)
    months = store.refresh(table, changed_months(changes, ["city_id"]))
    assert [m.isoformat() for m in months] == ["2020-03-01", "2020-09-01", "2021-05-01"]
    new = files(folder)
    assert {m for m in new if new[m] != old.get(m)} == {f"{MONTH}={m.isoformat()}" for m in months}
    full = MonthlyPartials(spark, str(tmp_path / "full"), ["city_id"], ["v"])
    full.build(table)
    key = lambda t: sorted(map(repr, t.select(*sorted(t.columns)).collect()))
    assert key(store.table()) == key(full.table())
    got = {r[0]: r[1] for r in store.table().groupBy("city_id").agg(F.round(store.mean("v"), 9)).collect()}
    for c in (0, 1, 2, 3, 4, 9):
        mine = [v for k, _, v in now if k == c and v is not None]
        assert got[c] == round(sum(mine) / len(mine), 9)
    assert store.refresh(table, changed_months(table.where("false"), ["city_id"])) == []


def test_a_month_that_lost_all_rows_is_gone(spark, tmp_path):
    schema = "city_id int, date date, v double"
    table = spark.createDataFrame([(1, DAY, 1.0), (1, DAY.replace(month=2), 2.0)], schema)
    store = MonthlyPartials(spark, str(tmp_path / "store"), ["city_id"], ["v"])
    store.build(table)
    left = table.filter("v = 2")
    store.refresh(left, changed_months(table.filter("v = 1"), ["city_id"]))
    assert [(r.city_id, r[MONTH].month, r.v_sum) for r in store.table().collect()] == [(1, 2, 2.0)]
