"""Near-duplicate groups by banded MinHash with odd-sketch verification.

1. One pass gives each document's distinct word shingles as 64-bit hashes, their count
   and digest, ``bands * rows`` MinHash values hashed into band keys, and the odd
   sketch of these values: every (position, value) flips one bit of a parity bitmap.
   Documents with equal sets become one node (partial aggregates, so copies of a third
   of all rows are no hot spot).
2. Nodes that share a band key are candidates.  Each is first compared with the least
   node of its bucket only.  The population count of two sketches' XOR estimates their
   Jaccard similarity closely where it is high; candidates that it puts below the
   threshold by ``sigmas`` standard errors are dropped, the rest are confirmed exactly
   on the full shingle sets.
3. Buckets whose nodes still lie in several components are searched by sketch, breadth
   first: a node that is reached is not compared again, and at most one edge per node is
   given out.  The components of these edges are families, which hold every candidate
   pair that is left.  Within a family links are confirmed in the same way on bitmaps of
   the full sets, and only links that join components are given out.
   No bucket or family is expanded into pairs; those of over ``block`` nodes are cut into
   blocks, and every two blocks meet in a group of their own.

With 32 bands of 4 rows a pair at the threshold 0.8 shares no band with probability
5e-8.  Documents with fewer words than a shingle take their whole word sequence as one;
documents without words link with nothing.  Null text counts as empty; null ids are
grouped, and components of null ids only have a null id; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import (ASCII_LOWER, column_bytes, drop_dir, keep_rows, map_batches, mix64, prefix_hash, sifted, slices,
                              span_hash, texts, words, work_dir, written)
from lapse.llm.components import components

BANDS, ROWS, SKETCH_BITS, SIGMAS, BLOCK, TEXT_BLOCK = 32, 4, 1024, 6.0, 16_384, 4096
SCHEMA = ("row_id long, doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>, "
          "sketch array<long>")


def shingles(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, first index of each text, n + 1 entries), with repeats."""
    lower = ASCII_LOWER[data]
    start, end, row = words(offsets, lower)
    word = span_hash(prefix_hash(lower), start, end)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], size)       # first word of each shingle
    span = np.repeat(np.minimum(count, width), size)
    out = span.astype(np.uint64)
    for k in range(width):
        use = span > k
        out[use] = mix64(out[use] + word[at[use] + k] * np.uint64(2 * k + 1))
    return out, begin


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix64(i) | np.uint64(1), mix64(i + np.uint64(1 << 20))


def sketch_batch(offsets: np.ndarray, data: np.ndarray, width: int, bands: int, rows: int, bits: int):
    """(count, digest, band keys, odd sketch words) per text."""
    hashes, begin = shingles(offsets, data, width)
    n = len(begin) - 1
    count, digest = np.zeros(n, np.int64), []
    for i in range(n):
        own = np.unique(hashes[begin[i]:begin[i + 1]])
        count[i] = len(own)
        digest.append(xxhash.xxh3_128_digest(own.tobytes()))
    full = np.flatnonzero(np.diff(begin) > 0)
    keys = np.zeros((len(full), bands), np.uint64)
    flips = np.zeros((len(full), bits), bool)
    everyone = np.arange(len(full))
    if len(full):
        for k, (a, b) in enumerate(zip(*coefficients(bands * rows))):
            least = np.minimum.reduceat(hashes * a + b, begin[full])
            band = k // rows
            keys[:, band] = mix64(keys[:, band] + mix64(least + np.uint64(band)))
            flips[everyone, mix64(least ^ mix64(np.uint64(k + 1) + np.zeros(1, np.uint64))) % np.uint64(bits)] ^= True
    sketch = np.packbits(flips, axis=1, bitorder="little").view(np.int64)
    return count, digest, full, keys, sketch


def sketches(docs: DataFrame, width: int = 2, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("row_id")).withColumn(
        "text_hash", F.xxhash64("text"))

    def run(batch):
        offsets, data = column_bytes(batch.column(1))
        parts = []
        for a, b in slices(offsets, 1 << 20):
            count, digest, full, keys, sketch = sketch_batch(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]],
                                                             width, bands, rows, bits)
            sizes = np.zeros(b - a + 1, np.int32)
            sizes[full + 1] = 1
            held = np.cumsum(sizes).astype(np.int32)
            parts.append(pa.RecordBatch.from_arrays(
                [batch.column(2)[a:b], batch.column(0)[a:b], batch.column(3)[a:b], pa.array(count),
                 pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(held * bands), pa.array(keys.view(np.int64).reshape(-1))),
                 pa.ListArray.from_arrays(pa.array(held * sketch.shape[1]), pa.array(sketch.reshape(-1)))],
                [f.split()[0] for f in SCHEMA.split(", ")]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return map_batches(base, run, SCHEMA)


def largest_distance(threshold: float, values: int, bits: int, sigmas: float) -> int:
    """The most differing sketch bits that ``sigmas`` standard errors below the threshold allow.

    Of ``values`` MinHash pairs a binomial share of 1 - J differs and flips two bits each;
    flips that meet cancel, which lowers the mean and adds a little variance."""
    flips = 2 * (1 - threshold) * values
    kept = (1 - 2 / bits) ** flips
    mean = bits / 2 * (1 - kept)
    variance = (2 * kept) ** 2 * values * threshold * (1 - threshold) + 2 * flips ** 2 / bits
    return int(np.ceil(mean + sigmas * np.sqrt(variance)))


def _distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirmed(pairs: DataFrame, node_texts: DataFrame, threshold: tuple[int, int], width: int, block: int = 512) -> DataFrame:
    """The pairs (u, v) whose sets have ``den * intersection >= num * union``.

    Texts of v meet that of u in groups of about ``block``: a u with many partners is split
    and its text repeated once per group.  Groups are streamed, one text of v at a time."""
    num, den = threshold
    groups = pairs.groupBy("u").count().select("u", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    left = (groups.join(node_texts, groups["u"] == node_texts["node"])
            .select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("v"), "text"))
    right = (pairs.join(groups, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v")
             .join(node_texts, F.col("v") == node_texts["node"]).select("u", "part", "v", "text"))
    rows = left.unionByName(right).repartition("u", "part").sortWithinPartitions("u", "part", "v")

    def run(batches):
        key, own = None, None
        for batch in batches:
            us, parts, vs = (batch.column(i).to_pylist() for i in range(3))
            offsets, data = column_bytes(batch.column(3))
            out = []
            for a, b in slices(offsets, 1 << 20):
                hashes, begin = shingles(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], width)
                for i in range(a, b):
                    other = np.unique(hashes[begin[i - a]:begin[i - a + 1]])
                    if vs[i] == -1:
                        key, own = (us[i], parts[i]), other
                        continue
                    if key != (us[i], parts[i]):
                        raise RuntimeError("the text of a pair's first node is missing")
                    both = len(own) + len(other) - len(np.union1d(own, other))
                    if den * both >= num * (len(own) + len(other) - both):
                        out.append((us[i], vs[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows dealt to bounded groups (key, i, j) in which any two rows of a key meet.

    A key of at most ``block`` rows is one group; a larger one is cut into blocks by the
    node's hash, and every two blocks are a group."""
    cut = rows.withColumn("__n", F.ceil(F.col(size) / block).cast("int")).drop(size)
    cut = cut.withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__n")).cast("int"))
    other = F.explode(F.when(F.col("__n") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda x: x != F.col("__own"))))
    cut = cut.withColumn("__other", other)
    cut = cut.withColumns({"i": F.least("__own", "__other"), "j": F.greatest("__own", "__other")}).drop("__n", "__own", "__other")
    return (cut.select(key, "i", "j", *(c for c in cut.columns if c not in (key, "i", "j")))
            .repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node"))


def groups(batches, n_keys: int = 3):
    """The tables of a stream that is sorted by its first ``n_keys`` integer columns."""
    held, last = [], None
    for batch in batches:
        keys = np.column_stack([batch.column(k).to_numpy() for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(near, roots: np.ndarray) -> list[tuple[int, int, bool]]:
    """Edges (x, y, new) of a spanning forest, breadth first.  ``near(x, others)`` gives the
    others that x reaches; nodes of one root are reached as well, with ``new`` false."""
    left, out = np.arange(len(roots)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            same = roots[left] == roots[x]
            hit = same.copy()
            hit[~same] = near(x, left[~same])
            for y, old in zip(left[hit], same[hit]):
                out.append((x, y, not old))
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def sketch_matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().view(np.uint64).reshape(len(values), -1)


_EDGES = "u long, v long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])


def alike(members: DataFrame, most: int, block: int) -> DataFrame:
    """Edges that join all nodes of a bucket whose sketches differ in at most ``most`` bits
    though they lie in different components; at most one edge per node and group.

    members: (band, n, node, root, sketch) with n the bucket's size."""
    def run(batches):
        for t in groups(batches):
            node, root, sketch = t["node"].to_numpy(), t["root"].to_numpy(), sketch_matrix(t["sketch"])
            found = forest(lambda x, rest: np.bitwise_count(sketch[rest] ^ sketch[x]).sum(1) <= most, root)
            if any(new for _, _, new in found):
                yield _edges([(node[x], node[y]) for x, y, _ in found])

    return blocked(members, "band", "n", block).mapInArrow(run, _EDGES).distinct()


def linked(families: DataFrame, most: int, threshold: tuple[int, int], width: int, block: int) -> DataFrame:
    """Links that join the components of a family, confirmed on the full sets.

    families: (family, size, node, root, sketch, text).  The sets of a group are bitmaps over
    the shingles that two of its texts share, so an intersection is a population count."""
    num, den = threshold

    def run(batches):
        for t in groups(batches):
            root, sketch = t["root"].to_numpy(), sketch_matrix(t["sketch"])
            node = t["node"].to_numpy()
            offsets, data = column_bytes(t["text"].combine_chunks())
            sets = []
            for a, b in slices(offsets, 1 << 20):
                hashes, begin = shingles(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], width)
                sets += [np.unique(hashes[begin[k]:begin[k + 1]]) for k in range(b - a)]
            size = np.array([len(x) for x in sets])
            _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            place = np.cumsum(count > 1) - 1
            shared = (count > 1)[number]
            row, bit = np.repeat(np.arange(len(sets)), size)[shared], place[number[shared]]
            bits = np.zeros((len(sets), (int((count > 1).sum()) + 63) // 64), np.uint64)
            np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))

            def near(x, rest):
                hit = np.bitwise_count(sketch[rest] ^ sketch[x]).sum(1) <= most
                some = rest[hit]
                both = np.bitwise_count(bits[some] & bits[x]).sum(1, dtype=np.int64)
                hit[hit] = den * both >= num * (size[some] + size[x] - both)
                return hit

            if found := [(node[x], node[y]) for x, y, new in forest(near, root) if new]:
                yield _edges(found)

    return blocked(families, "family", "size", block).mapInArrow(run, _EDGES).distinct()


def near_duplicates(docs: DataFrame, width: int = 2, threshold: tuple[int, int] = (80, 100), bands: int = BANDS,
                    rows: int = ROWS, bits: int = SKETCH_BITS, sigmas: float = SIGMAS, block: int = BLOCK,
                    text_block: int = TEXT_BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash; one row per input row.

    Kept is one text per group: of the least id (null ids last), of one id's the least hash."""
    spark = docs.sparkSession
    folder = work_dir(spark, "near-dedup")
    most = largest_distance(threshold[0] / threshold[1], bands * rows, bits, sigmas)
    sketched = written(sketches(docs, width, bands, rows, bits, id_col, text_col), f"{folder}/sketched")
    nodes = written(sketched.where("n_shingles > 0").groupBy("set_hash")
                    .agg(F.min("row_id").alias("node"), F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")).alias("least"),
                         F.min(F.struct("doc_id", "text_hash")).alias("at"),
                         F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), f"{folder}/nodes")
    sketch_of = nodes.select("node", "sketch")

    keyed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keyed.join(buckets, "band"), f"{folder}/members")          # only buckets with candidates

    def close(pairs: DataFrame) -> DataFrame:
        return (pairs.join(sketch_of, pairs["v"] == sketch_of["node"]).select("u", "v", F.col("sketch").alias("b"))
                .join(sketch_of, F.col("u") == sketch_of["node"]).where(_distance("sketch", "b") <= most).select("u", "v"))

    def fetch(wanted: DataFrame, step: str) -> DataFrame:
        wanted = written(nodes.join(wanted, "node").select("node", "at.doc_id", "at.text_hash"), f"{folder}/wanted{step}")
        found = sifted(texts(docs, id_col, text_col), "doc_id", wanted).withColumn("text_hash", F.xxhash64("text"))
        return written(found.join(wanted, found["doc_id"].eqNullSafe(wanted["doc_id"])
                                  & (found["text_hash"] == wanted["text_hash"])).select("node", "text")
                       .dropDuplicates(["node"]), f"{folder}/texts{step}")

    stars = members.where("node != leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    pairs = written(close(stars), f"{folder}/pairs1")
    node_texts = fetch(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "1")
    links = written(confirmed(pairs, node_texts, threshold, width), f"{folder}/links1")
    drop_dir(spark, f"{folder}/texts1")
    roots = written(components(links), f"{folder}/roots1")

    # Buckets that still hold several components: join what looks alike into families.
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).where("n > 2")
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    rest = placed.join(mixed, "band", "left_semi").join(sketch_of, "node").select("band", "n", "node", "root", "sketch")
    edges = written(alike(rest, most, block), f"{folder}/alike")
    families = written(components(edges), f"{folder}/families").withColumnRenamed("root", "family")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    node_texts = fetch(families.select("node"), "2")
    rows = (families.join(sizes, "family").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            .join(sketch_of, "node").join(node_texts, "node").select("family", "size", "node", "root", "sketch", "text"))
    more = written(linked(rows, most, threshold, width, text_block), f"{folder}/links2")
    drop_dir(spark, f"{folder}/texts2")
    roots = written(components(links.unionByName(more)), f"{folder}/roots2")

    rooted = nodes.select("set_hash", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))       # a null id comes last
    of_set = written(rooted.join(least, "root").select("set_hash", "first"), f"{folder}/components")
    for done in ("nodes", "members", "pairs1", "links1", "roots1", "alike", "families", "links2", "roots2"):
        drop_dir(spark, f"{folder}/{done}")
    out = sketched.select("doc_id", "text_hash", "n_shingles", "set_hash").join(of_set, "set_hash", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(component) & (F.col("text_hash") == F.col("first.text_hash")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; all columns stay."""
    return keep_rows(docs, near_duplicates(docs, **options))
