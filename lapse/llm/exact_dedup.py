"""Exact deduplication with disk-backed streaming state.

Rows are fingerprinted once (digest of the text with A-Z lower-cased, id, content
locator) into the shared work folder.  A Structured Streaming aggregation reads the
fingerprints in micro-batches and keeps, per digest and without expiry, the id of the
row that stays, its locator and the number of rows, in RocksDB state stores that are
checkpointed to the shared folder.  Partial aggregation before the shuffle makes a
digest of a third of all rows one row per task.  An incremental job calls ``absorb``
again with new fingerprints and the same state folder.

On hits (digests with several rows) the full bytes are compared: least and greatest
text per digest must be equal.  Where they are not, the rows of such digests are
grouped by their whole text instead, so a digest collision joins nothing.

Null text counts as empty.  Ties in the id go to the later row; a null id is below
every id; repeated rows count as copies, one of which stays; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm.common import keep_rows, texts, work_dir, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",     # many small stores: no space kept ahead
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def normalised(text: str = "text") -> Column:
    return F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def fingerprints(docs: DataFrame, digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_id, file, digest, text_hash, key (the part of the digest the state is kept by).

    ``row_id`` is partition and row number; with the file it locates the content."""
    return (texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("row_id"),
                  F.input_file_name().alias("file"))
            .select("doc_id", "row_id", "file", text_digest().alias("digest"), F.xxhash64("text").alias("text_hash"))
            .withColumn("key", F.col("digest") if digest_bytes >= 32 else F.substring("digest", 1, digest_bytes)))


def absorb(spark: SparkSession, fingerprint_folder: str, folder: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    """Run the stream over all fingerprints not seen yet; returns the state's latest view:
    key, keep (struct of doc_id, row_id, file), group_size."""
    schema = spark.read.parquet(fingerprint_folder).schema
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = (spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(fingerprint_folder)
                  .groupBy("key").agg(F.max(F.struct("doc_id", "row_id", "file")).alias("keep"),
                                      F.count(F.lit(1)).alias("group_size")))

        (stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/stream")
         .trigger(availableNow=True).start().awaitTermination())
        # The state itself is the result: key and aggregation buffers, read from its checkpoint.
        value = spark.read.format("statestore").load(f"{folder}/stream").select("key.key", "value.*")
        keep, group_size = [c for c in value.columns if c != "key"]
        return written(value.select("key", F.col(keep).alias("keep"), F.col(group_size).alias("group_size")),
                       f"{folder}/state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def differing_keys(docs: DataFrame, hits: DataFrame, digest_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Keys among the hits whose rows don't all have the same bytes."""
    rows = (texts(docs, id_col, text_col).select(normalised().alias("text"), text_digest().alias("digest"))
            .select("text", F.substring("digest", 1, digest_bytes).alias("key"))
            .withColumn("short", F.xxhash64("key")).join(hits.select(F.xxhash64("key").alias("short")), "short", "left_semi"))
    return (rows.groupBy("key").agg(F.min("text").alias("low"), F.max("text").alias("high"))
            .where(F.col("low") != F.col("high")).select("key"))


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, bytes_per_batch: int = 1 << 30, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash; one row per input row."""
    spark = docs.sparkSession
    folder = work_dir(spark, "exact-dedup")
    prints = written(fingerprints(docs, digest_bytes, id_col, text_col), f"{folder}/fingerprints")
    if prints.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, "
                                         "text_sha256 string, text_hash long")
    state = absorb(spark, f"{folder}/fingerprints", folder, bytes_per_batch)
    hits = written(state.where("group_size > 1").select("key"), f"{folder}/hits")   # small enough: broadcast by its size
    differing = written(differing_keys(docs, hits, digest_bytes, id_col, text_col), f"{folder}/differing")
    out = prints.join(state, "key", "inner")
    if not differing.isEmpty():
        by_text = (texts(docs, id_col, text_col).select("doc_id", normalised().alias("text"), text_digest().alias("digest"))
                   .withColumn("key", F.substring("digest", 1, digest_bytes)).join(differing, "key", "left_semi"))
        again = (by_text.groupBy("text").agg(F.first("digest").alias("digest"), F.max("doc_id").alias("top"),
                                             F.count(F.lit(1)).alias("n")))
        keepers = (prints.join(differing, "key", "left_semi").groupBy("digest")
                   .agg(F.max(F.struct("doc_id", "row_id", "file")).alias("exact_keep")))
        exact = again.select("digest", "n").join(keepers, "digest")
        out = (out.join(exact, "digest", "left").withColumn("keep", F.coalesce("exact_keep", "keep"))
               .withColumn("group_size", F.coalesce("n", "group_size")))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                      (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "text_hash")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay."""
    return keep_rows(docs, exact_dedup(docs, id_col=id_col, text_col=text_col), id_col, text_col)
