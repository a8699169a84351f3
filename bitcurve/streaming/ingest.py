"""Resumable ingest (K3): measured clips are skipped, records with a stale key are set aside.

Records lie in ``records/batch=<id>/slice=<hash bucket of the source>``. A batch looks for known keys only in the
slices that its own sources fall into, so what it reads follows its sources, not the age of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitcurve.session import written

SLICES = 256  # fixed for the life of a store
KEYS = ("source_id", "codec", "cache_key")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows; None only where nothing is stored yet. Damage of any kind is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def known_keys(spark: SparkSession, store: str, batch_id: int, slices: list[int], keys=KEYS) -> DataFrame | None:
    """Keys that other batches stored in the given slices; the other slices are pruned from the listing."""
    known = _read(spark, f"{store}/records")
    if known is None:
        return None
    return known.filter((F.col("batch") != batch_id) & F.col("slice").isin(slices)).select(*keys)


def merge_batch(batch: DataFrame, batch_id: int, store: str, expected_key: str, keys=KEYS) -> None:
    """Append the batch's new records to ``store/records`` and stale ones to ``store/stale``.

    Each batch owns a folder that it overwrites, and does not look at its own folder when it looks
    for known keys, so a retried batch writes the same rows again. A batch without new records leaves no folder
    of records."""
    spark = batch.sparkSession
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys]
    # Repeats within the batch collapse map-side; the lowest row wins.
    unique = batch.groupBy(*keys).agg(F.expr(f"min(struct({', '.join(rest)})) AS v")).select(*keys, "v.*")
    unique = written(unique.withColumn("slice", F.expr(f"int(pmod(hash({keys[0]}), {SLICES}))")), "batch")
    stale = unique.filter(f"NOT (cache_key <=> ({expected_key}))").drop("slice")
    fresh = unique.filter(f"cache_key <=> ({expected_key})")
    slices = [row["slice"] for row in fresh.select("slice").distinct().collect()]  # at most SLICES
    earlier = known_keys(spark, store, batch_id, slices, keys)
    if earlier is not None:
        fresh = fresh.join(earlier, keys, "left_anti")
    if slices:
        # A slice's rows go to one file, unless a batch brings so many that AQE cuts them.
        spread = fresh.hint("rebalance", "slice")
        target = spread.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slice")
        target.parquet(f"{store}/records/batch={batch_id}")
    stale.write.mode("overwrite").parquet(f"{store}/stale/batch={batch_id}")


def ingest(stream: DataFrame, store: str, checkpoint: str, expected_key: str, keys=KEYS) -> None:
    """Run the stream over everything available."""
    query = (
        stream.writeStream.foreachBatch(lambda b, i: merge_batch(b, i, store, expected_key, keys))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
