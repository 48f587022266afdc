"""Registration of queries and access to the test tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Workload:
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


REGISTRY: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None):
    def register(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Workload(run, sql)
        return run

    return register


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints; on one machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        return tempfile.mkdtemp(prefix="cotejo-")
    return f"{shared.rstrip('/')}/cotejo-{uuid.uuid4().hex}"


def scratch_database(spark: SparkSession) -> str:
    """A fresh catalog database in a scratch folder."""
    name = f"cotejo_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark)}'")
    return name
