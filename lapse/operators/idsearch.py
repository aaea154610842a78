"""Substring search over ids (P9) with a posting table of grams.

``postings`` lists every id under each of its distinct lower-case substrings of one to three
characters, and under the empty string.  A search reads one posting list: a text of up to
three characters is itself a gram; a longer one takes its rarest trigram, and the ids found
there are verified.  The table is range-partitioned and sorted by gram, so a scan with the
gram as a filter opens few row groups; only candidates are looked at, not all ids.

Results equal those of ``serve.search_ids``: the first ``limit`` ids in id order that hold the
text in any case.  Null ids are in no list; a null text finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, sizes: range) -> Column:
    """Distinct substrings of the given sizes."""
    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - size + 1)
        return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(of, sizes)))))


def postings(ids: DataFrame, key: str = "msno") -> DataFrame:
    """(gram, msno): every distinct id under its grams."""
    distinct = ids.select(F.col(key).cast("string").alias("msno")).where("msno is not null").distinct()
    grams = F.concat(F.array(F.lit("")), _grams(F.lower("msno"), range(1, GRAM + 1)))
    return distinct.select(F.explode(grams).alias("gram"), "msno")


def write_postings(ids: DataFrame, path: str, key: str = "msno") -> None:
    """The posting table and the lengths of its lists, below ``path``."""
    found = postings(ids, key).repartitionByRange("gram", "msno").sortWithinPartitions("gram", "msno")
    found.write.mode("overwrite").parquet(f"{path}/postings")
    spark = ids.sparkSession
    (spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
     .repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/lengths"))


def chosen_grams(queries: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query, text, gram, n): the rarest gram of each distinct text; texts with a gram that no id
    has are left out."""
    text = F.lower("query")
    asked = queries.select(F.col("query")).where("query is not null").distinct().withColumn("text", text)
    grams = asked.withColumn("gram", F.explode(F.when(F.length("text") <= GRAM, F.array("text")).otherwise(_grams(F.col("text"), range(GRAM, GRAM + 1)))))
    held = grams.join(lengths, "gram", "left")
    return (held.groupBy("query", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
            .where("m.n > 0").select("query", "text", F.col("m.gram").alias("gram"), F.col("m.n").alias("n")))


def search(queries: DataFrame, posting_table: DataFrame, lengths: DataFrame, limit: int = 10) -> DataFrame:
    """(query, rank, msno, candidates): per distinct text of ``queries`` (query) its first ``limit``
    ids; ``candidates`` is the number of ids that were looked at.  A text's matches are cut to
    ``limit`` in every task before they are ranked."""
    wanted = chosen_grams(queries, lengths)
    found = wanted.join(posting_table, "gram").where(F.contains(F.lower("msno"), F.col("text")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("msno"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "msno", F.col("n").alias("candidates"))
