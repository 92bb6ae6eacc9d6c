import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from airloom.model import CITIES, READINGS  # noqa: E402
from airloom.session import local_session  # noqa: E402
from airloom.sources.tables import Dataset, load  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(app="airloom-tests")


@pytest.fixture(scope="session")
def small(spark):
    return load(spark, SMALL)


@pytest.fixture(scope="session")
def make(spark):
    """A dataset from {city: [(date, aqi) or (date, {measure: value})]}."""
    import datetime

    def build(series):
        names = list(series)
        cities = spark.createDataFrame([(i, n, f"S{i}", "R") for i, n in enumerate(names)], CITIES)
        rows = []
        for i, n in enumerate(names):
            for day, value in series[n]:
                given = value if isinstance(value, dict) else {"aqi_daily": value}
                rows.append(
                    (i, datetime.date.fromisoformat(day))
                    + tuple(None if given.get(m) is None else float(given[m]) for m in ("co", "no2", "o3", "pm10", "pm25", "aqi_daily"))
                )
        return Dataset(spark.createDataFrame(rows, READINGS), cities)

    return build


@pytest.fixture(scope="session")
def ragged(spark):
    """Random readings with gaps over several years; one city has most of the rows."""
    import datetime
    import random

    rng = random.Random(7)
    rows, start = [], datetime.date(2018, 3, 1)
    for city, days, keep in ((0, 1500, 0.95), (1, 400, 0.5), (2, 90, 0.3), (3, 5, 1.0)):
        for d in range(days):
            if rng.random() < keep:
                pm = None if rng.random() < 0.2 else round(rng.uniform(0, 300), 2)
                rows.append((city, start + datetime.timedelta(days=d), 1.0, 2.0, None if rng.random() < 0.5 else round(rng.uniform(0, 9), 2), 4.0, pm, round(rng.uniform(0, 500), 1)))
    return spark.createDataFrame(rows, READINGS), rows
