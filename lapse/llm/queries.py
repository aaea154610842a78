"""Registered queries of the text operators and their DuckDB mirrors."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import (bpe_stream, exact_dedup, fingerprints, hard_negatives, line_rules, near_dedup, packing, periodic_runs, prefix_free,
                       pu_quality, reply_trees, secret_scan, token_counts)
from lapse.llm.common import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


# Fixed value: the text of the two rows that the contract adds as conversation -7.
PROBE = "\\### Assistant: </turn> ok"


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return reply_trees.conversation_digests(table.unionByName(probe))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(read_table(spark, sf_dir, "documents"))


def op6_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_texts(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(read_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_reply_trees": op4_reply_trees,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_line_rules": op6_line_rules,
    "op6_clean_texts": op6_clean_texts,
    "op7_packing": op7_packing,
    "op8_prefix_free": op8_prefix_free,
    "op9_pu_quality": op9_pu_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fingerprints": op12_fingerprints,
    "op13_hard_negatives": op13_hard_negatives,
}

# DuckDB mirrors.  Tokens (1, 5, 7), span positions (3), byte windows (8), fitted scores (9), runs (11)
# and signatures (12) aren't expressible; tests compare those with the library or plain Python.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format
_SPARE = r"(length({0}) + length(regexp_replace({0}, '[^\\<>]', '', 'g')))".format     # escaped length

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",

    "op4_reply_trees": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(15 + {_SPARE("role")} + {_SPARE("text")}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars
FROM g""",

    "op6_line_rules": rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS("t")} AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
three AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
          FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM three WHERE third IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
line AS (SELECT doc_id, host, t, unnest(lines) AS line FROM w),
normal AS (SELECT *, len({_WORDS("line")}) AS n, array_to_string({_WORDS("regexp_replace(" + _LOWER("line") + ", '[0-9]', '0', 'g')")}, ' ') AS norm FROM line),
frequent AS (SELECT host, norm FROM normal GROUP BY host, norm HAVING count(DISTINCT t) > 20),
removed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS words_removed FROM normal JOIN frequent USING (host, norm) GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_removed, 0) AS words_removed
      FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words - words_removed < 0.3 * n_words OR n_words - words_removed < 50 AS depleted FROM m)
SELECT * EXCLUDE (depleted), NOT base_failed AND NOT depleted AS kept FROM f""",

    "op10_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS(_LOWER("coalesce(text, '')"))} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) < 2 THEN words
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingles FROM w),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b USING (shingle)
          WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT u, v FROM both_ WHERE 100 * c >= 80 * (n + m - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u),
least_ AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN least_ USING (doc_id)""",

    "op13_hard_negatives": """
WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
        AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
