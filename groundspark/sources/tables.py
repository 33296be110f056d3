"""Intermediate tables in the folder that the cluster shares; small inputs spread over the cores."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Input bytes up to which rows are dealt to all cores before work on them; larger inputs have splits enough, and aren't shuffled.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows on as many tasks as there are cores where the input is small: a file of one row group is one task however long its texts take."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


@cache
def _own_folder() -> str:
    """A folder of this process, gone with it: for tests and single machines only."""
    folder = tempfile.mkdtemp(prefix="groundspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may do without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: tasks need a folder that all machines share")
    return shared or _own_folder()


def materialized(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
