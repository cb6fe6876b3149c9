"""Streaming ingest: files land, rows are accepted once, live state follows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siltstone.operators.ledger import accept


def arrivals(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Folders of a ledger, by hash of the key.
BUCKETS = 16


def ingest(stream: DataFrame, ledger: str, checkpoint: str, *key: str, valid: Column | None = None, quarantine: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append rows that the ledger at path ``ledger`` does not hold, each once.  A batch that runs again after a failure
    finds its rows there and adds none.  The ledger lies in folders by hash of the key, and a batch reads the keys of its
    own folders alone.  With ``valid``, rows that are not go to ``quarantine``, a folder a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if valid is not None:
            fit = F.coalesce(valid, F.lit(False))
            rows.where(~fit).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
            rows = rows.where(fit)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        try:
            held = spark.read.schema(rows.schema).parquet(ledger)
        except AnalysisException as e:  # the ledger is made by the first batch
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = spark.createDataFrame([], rows.schema)
        own = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        accept(rows, held.where(F.col("bucket").isin(own)), *key).write.mode("append").partitionBy("bucket").parquet(ledger)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))
