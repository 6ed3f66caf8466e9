"""Upserts of a stream by natural key, batch by batch, with a log of changes; a batch that is run again changes nothing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions.durable import ensure_checkpoint_dir

#: Buckets that the table is kept in; a batch rewrites only those that it touches.
BUCKETS = 16
# What a month is based on, by how much it is believed.
PRIORITY = {"unknown": 0, "earliest_related_article_month": 1, "inferred": 2, "explicit_in_article": 3}


def priority(basis: Column) -> Column:
    return F.coalesce(*[F.when(basis == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(0))


def _folders(spark: SparkSession, base: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def _versions(spark: SparkSession, base: str, before: int | None = None) -> dict[int, int]:
    """{bucket: its last batch}, of batches before one if it is given; a few names for each bucket are read."""
    last: dict[int, int] = {}
    for bucket in _folders(spark, f"{base}/table"):
        done = [int(x.split("=")[1]) for x in _folders(spark, f"{base}/table/{bucket}") if x.startswith("batch=") and (before is None or int(x.split("=")[1]) < before)]
        if done:
            last[int(bucket.split("=")[1])] = max(done)
    return last


def _read(spark: SparkSession, base: str, versions: dict[int, int], schema: str) -> DataFrame:
    parts = [spark.read.schema(schema).parquet(f"{base}/table/bucket={b}/batch={v}") for b, v in sorted(versions.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each natural key: the known month with the highest basis (the later of equals), and the rows counted.

    Rows have month, basis, seq and rows; combining is associative, so it does not matter how they are cut in batches.
    """
    known = F.max_by(F.struct("month", "basis", "seq"), F.struct(F.col("month").isNotNull().alias("known"), priority(F.col("basis")).alias("p"), "seq"))
    grouped = rows.groupBy(*keys).agg(known.alias("k"), F.sum("rows").alias("rows"))
    return grouped.select(*keys, F.col("k.month").alias("month"), F.col("k.basis").alias("basis"), F.col("k.seq").alias("seq"), "rows")


def upserted(spark: SparkSession, stream: DataFrame, keys: list[str], base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after a stream of observations (keys, month, basis, seq), and the log of what each batch changed.

    A month replaces another if its basis is believed at least as much; an unknown month never does. A bucket of the
    table is a folder for each batch that touched it: a batch reads the last one before it and writes its own, so one
    that is run again writes the same once more. The log has one row for each key that a batch inserted or changed.
    """
    ensure_checkpoint_dir(spark)
    base = base or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/upserts-{uuid.uuid4().hex}"
    kinds = dict(stream.dtypes)
    row = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", month string, basis string, seq long, rows long"
    log = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", action string, month_before string, month_after string, basis_before string, basis_after string, rows_added long"

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = combined(batch.withColumn("rows", F.lit(1).cast("long")), keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            versions = {b: v for b, v in _versions(session, base, number).items() if b in touched}
            old = _read(session, base, versions, row)
            merged = combined(old.unionByName(new.drop("bucket")), keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
            for bucket in touched:
                merged.where(F.col("bucket") == bucket).drop("bucket").write.mode("overwrite").parquet(f"{base}/table/bucket={bucket}/batch={number}")
            after = _read(session, base, {b: number for b in touched}, row)
            sign = F.to_json(F.struct(*keys)).alias("_sign")  # a null is a key like any other
            was = old.select(sign, F.col("month").alias("month_before"), F.col("basis").alias("basis_before"), F.lit(True).alias("_known"))
            added = new.select(sign, F.col("rows").alias("rows_added"))
            joined = after.select("*", sign).join(added, "_sign").join(was, "_sign", "left")
            action = F.when(F.col("_known").isNull(), "insert").when(~F.col("month").eqNullSafe(F.col("month_before")) | ~F.col("basis").eqNullSafe(F.col("basis_before")), "month").otherwise("count")
            changes = joined.select(*keys, action.alias("action"), "month_before", F.col("month").alias("month_after"), "basis_before", F.col("basis").alias("basis_after"), "rows_added")
            changes.write.mode("overwrite").parquet(f"{base}/log/batch={number}")
        finally:
            new.unpersist()

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    logged = spark.read.schema(log + ", batch long").parquet(f"{base}/log") if _folders(spark, f"{base}/log") else spark.createDataFrame([], log + ", batch long")
    return _read(spark, base, _versions(spark, base), row), logged
