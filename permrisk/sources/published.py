"""Publishing predictions and appending them to the chain as one step that can be run again.

A store holds entries in a folder for each epoch and a manifest with a row for
each. Entries count once their epoch is in the manifest, which is written last:
what a broken-off batch left behind is neither read nor chained, and running it
again replaces it. An epoch that is in the manifest changes nothing. The chain
is extended from the last hash of the manifest and never built anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.operators.ranks import running_total
from permrisk.plans.ledger import GENESIS, chain

ENTRY = "epoch bigint, seq bigint, subject bigint, payload string, payload_hash string, prev_hash string, entry_hash string"
MANIFEST = "epoch bigint, entries bigint, refused bigint, last_seq bigint, head string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store, empty where nothing is written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/manifest", MANIFEST)


def entries(spark: SparkSession, store: str) -> DataFrame:
    """The published entries: those of the epochs in the manifest."""
    return _read(spark, f"{store}/entries", ENTRY).join(F.broadcast(manifest(spark, store).select("epoch")), "epoch", "left_semi")


def publish(predictions: DataFrame, store: str, epoch: int) -> None:
    """Append (subject, payload) of one batch, by subject. A subject that is published, or comes again in the batch, is refused and counted.

    Of several predictions of one subject in a batch the first payload in order is taken. Null subjects or payloads are refused.
    """
    spark = predictions.sparkSession
    known = manifest(spark, store)
    head = known.agg(F.max("last_seq").alias("seq"), F.max_by("head", "epoch").alias("head"), F.count_if(F.col("epoch") == epoch).alias("here")).first()
    if head.here:
        return
    last, before = -1 if head.seq is None else head.seq, head.head or GENESIS
    asked = predictions.select(F.col("subject").cast("bigint").alias("subject"), "payload")
    one = asked.where("subject IS NOT NULL AND payload IS NOT NULL").groupBy("subject").agg(F.min("payload").alias("payload"))
    new = one.join(entries(spark, store).select("subject"), "subject", "left_anti")
    linked = chain(new, "subject", "payload", before)
    # numbers without gaps, counted by ranges of subjects
    low, high = linked.agg(F.min("subject"), F.max("subject")).first()
    low, wide = low or 0, (high or 0) - (low or 0) + 1
    placed = running_total(linked, (F.col("subject") - low) / wide, [F.col("subject")], F.lit(1), "below")
    placed.select(F.lit(epoch).cast("bigint").alias("epoch"), (F.col("below") + last + 1).cast("bigint").alias("seq"), "subject", "payload", "payload_hash", "prev_hash", "entry_hash").write.mode("overwrite").parquet(f"{store}/entries/{epoch:012d}")
    done = spark.read.schema(ENTRY).parquet(f"{store}/entries/{epoch:012d}").agg(F.count(F.lit(1)).alias("n"), F.max_by("entry_hash", "seq").alias("head")).first()
    row = (epoch, done.n, asked.count() - done.n, last + done.n, done.head or before)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{epoch:012d}")


def publisher(store: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that the stream sends again after a failure leaves one copy."""
    return lambda batch, epoch: publish(batch, store, epoch)
