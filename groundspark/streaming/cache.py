"""Recorded model answers as a stream: new answers join the table once each, however often a batch is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def record_answers(answers: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends streamed answers (digest, response, created_at) whose digest the Parquet folder `table` lacks."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["digest"])
        try:
            fresh = fresh.join(spark.read.parquet(table).select("digest"), "digest", "left_anti")
        except Exception as missing:  # the first batch makes the table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        fresh.write.mode("append").parquet(table)

    return answers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
