"""Incremental ingestion: new extracted documents become cells as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finsift.sources.reports import RAW_DOCUMENT, cells, named


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Read what is new in a folder of extracted documents and write its cells, by
    batch and year; a batch that is run again replaces what it wrote."""
    code, year = named(F.col("_metadata.file_name"))
    docs = spark.readStream.schema(RAW_DOCUMENT).option("multiLine", True).json(folder).withColumn("stock_code", code).withColumn("year", year)

    def write(batch: DataFrame, number: int) -> None:
        rows = cells(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "year").parquet(out)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(cells: DataFrame) -> DataFrame:
    """Cells of each company-year's last batch: a document that came again replaces
    what it gave before."""
    last = cells.groupBy("stock_code", "year").agg(F.max("batch").alias("batch"))
    return cells.join(last, ["stock_code", "year", "batch"])
