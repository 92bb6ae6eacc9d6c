"""Write the results of many questions as JSON documents, one folder per question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airloom.plans.ingest import metadata
from airloom.sources.files import write_documents
from airloom.sources.tables import Dataset


def publish(spark: SparkSession, ds: Dataset, folder: str, plans: dict[str, Callable[[Dataset], DataFrame]]) -> DataFrame:
    """Run every plan and write its rows under `folder/<name>`.

    A plan that fails leaves a placeholder with its message and does not stop the
    others.  Dataset metadata goes to `folder/metadata`.  Returns one row per plan."""
    outcome = []
    for name, plan in plans.items():
        try:
            write_documents(plan(ds), f"{folder}/{name}")
            outcome.append((name, None))
        except Exception as bad:  # noqa: BLE001
            message = f"{type(bad).__name__}: {str(bad).splitlines()[0]}"
            placeholder = spark.createDataFrame([(name, message)], "query string, error string")
            placeholder.write.mode("overwrite").json(f"{folder}/{name}")
            outcome.append((name, message))
    write_documents(metadata(ds), f"{folder}/metadata")
    return spark.createDataFrame(outcome, "query string, error string")
