"""Conversations from reply trees, in DataFrame operations only.

1. Self-joins that double their reach enumerate paths: after round k each message knows
   its ancestor 2**k replies up, its depth and the score summed on the way, so a tree of
   depth d takes log2(d) joins.  Each round is written to the shared folder.
2. A branch is a leaf's path to its root.  Branches are ranked per tree by summed score
   (ties: the earlier leaf), and the best ``branches`` of each tree are chosen; the same
   jump tables then list all messages of the chosen paths.
3. A path is formatted as one conversation: per message ``<turn ROLE>TEXT</turn>\\n``.
   Inside roles and texts ``\\``, ``<`` and ``>`` become ``\\b``, ``\\l`` and ``\\g``, so no control
   string can stand in a text and the escape is undone exactly.  The loss mask is a list
   of byte spans of the formatted text, one per text of a ``loss_role`` message.

Messages are put together in blocks of ``BLOCK`` before they meet in their path's row, so
long paths are spread over tasks; only the finished text of a conversation, which is one
value by definition, is in one place.

Null text and role count as empty; null conversation ids are one conversation; rows equal
in all columns are messages of their own; equal turns are ordered by role, then by a hash
of the text; conversations without rows give no row; extra columns are ignored.  A message
whose parent is missing starts a tree of its own.  Messages that answer each other in a
circle (or themselves) have no root: the circle's message of least node starts the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import work_dir, written

BLOCK = 64
COUNTED_ROUNDS = 6                       # paths of up to 64 replies are done before messages are counted
OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chained(messages: DataFrame, order: list[str], tree: str = "tree") -> DataFrame:
    """``messages`` (tree, node, *order) with ``parent``: the node before it in its tree.

    Orders are taken within blocks of turns first, then over the blocks' ends, so a very
    long conversation isn't one task's window."""
    blocks = messages.withColumn("block", F.coalesce(F.floor(F.col(order[0]) / BLOCK), F.lit(-(1 << 40))))
    inside = Window.partitionBy(tree, "block").orderBy(*(F.col(c).asc_nulls_first() for c in order), "node")
    rows = blocks.withColumn("parent", F.lag("node").over(inside))
    key = F.struct(*order, "node")
    ends = blocks.groupBy(tree, "block").agg(F.max(key)["node"].alias("last"))
    before = ends.select(F.col(tree).alias("t"), F.col("block").alias("b"),
                         F.lag("last").over(Window.partitionBy(tree).orderBy("block")).alias("before"))
    return (rows.join(before, rows[tree].eqNullSafe(before["t"]) & (rows["block"] == before["b"]), "left")
            .withColumn("parent", F.coalesce("parent", "before")).select("node", "parent"))


def jump_tables(replies: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """replies: (node, parent, score).  ([node -> up 2**k], (node, root, depth, score), the replies
    without circles).

    A message that has no root after as many steps as there are messages leads into a
    circle.  Those steps lead onto the circle itself, and the least node passed on the way from
    a message on it is the circle's: there it is cut, once for all circles."""
    known = replies.select(F.col("node").alias("id"))
    now = written(replies.join(known, replies["parent"] == known["id"], "left")
                  .select("node", F.col("id").alias("up"), F.when(F.col("id").isNull(), F.col("node")).alias("root"),
                          F.lit(0).cast("long").alias("depth"), F.col("score").cast("double").alias("score"),
                          F.col("node").alias("low")), f"{folder}/jump0")
    # depth and score: over the messages passed so far, the one the row stands at not counted in depth
    jumps, total = [], None
    while True:
        open_ = now.where("up is not null")
        if open_.isEmpty():
            return jumps, now.select("node", "root", "depth", "score"), replies
        if len(jumps) >= COUNTED_ROUNDS:
            total = total or replies.count()
            if 1 << len(jumps) > total:
                break
        jumps.append(open_.select("node", "up"))
        far = now.select(F.col("node").alias("id"), F.col("up").alias("up2"), F.col("root").alias("root2"),
                         F.col("depth").alias("depth2"), F.col("score").alias("score2"), F.col("low").alias("low2"))
        step = 1 << (len(jumps) - 1)
        moved = (open_.join(far, open_["up"] == far["id"])
                 .select("node", F.col("up2").alias("up"), F.col("root2").alias("root"),
                         (F.lit(step) + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"),
                         F.least("low", "low2").alias("low")))
        now = written(moved.unionByName(now.where("up is null")), f"{folder}/jump{len(jumps)}")
    circle = open_.select(F.col("up").alias("node")).distinct().join(now.select("node", "low"), "node")
    cut = written(circle.where("node = low").select(F.col("node").alias("first")), f"{folder}/circles")
    opened = replies.join(cut, replies["node"] == cut["first"], "left").select(
        "node", F.when(F.col("first").isNull(), F.col("parent")).alias("parent"), "score")
    return jump_tables(written(opened, f"{folder}/opened"), f"{folder}/opened-jumps")


def chosen_paths(replies: DataFrame, folder: str, branches: int) -> DataFrame:
    """(leaf, node, depth, rank) for every message of the best ``branches`` paths of each tree."""
    jumps, placed, replies = jump_tables(replies, folder)
    parents = replies.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = placed.join(parents, "node", "left_anti")
    best = Window.partitionBy("root").orderBy(F.col("score").desc(), "node")
    paths = (leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
             .select(F.col("node").alias("leaf"), "node", "rank"))
    for k, jump in enumerate(jumps):      # after round k: the 2**(k + 1) lowest messages of each path
        up = jump.select(F.col("node").alias("id"), "up")
        paths = written(paths.unionByName(paths.join(up, paths["node"] == up["id"]).select("leaf", F.col("up").alias("node"), "rank")),
                        f"{folder}/paths{k}")
    return paths.join(placed.select("node", "depth"), "node")


def formatted_paths(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(leaf, formatted, loss_spans) from (leaf, node, depth) and (node, role, text)."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(">"))
    rows = (paths.select("leaf", "node", "depth").join(messages.select("node", "role", "text"), "node")
            .withColumns({"head": head, "body": escaped(F.col("text")), "block": F.floor(F.col("depth") / BLOCK)}))
    piece = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.octet_length("head").alias("head"),
                     F.octet_length("body").alias("body"), (F.col("role") == loss_role).alias("loss"))
    blocks = rows.groupBy("leaf", "block").agg(F.sort_array(F.collect_list(piece)).alias("p"))

    def total(sizes, n):                  # bytes of the first n
        return F.aggregate(F.slice(sizes, 1, n), F.lit(0), lambda a, x: a + x)

    blocks = blocks.withColumn("sizes", F.transform("p", lambda x: F.octet_length(x["piece"])))
    spans = F.transform("p", lambda x, i: F.struct((total(F.col("sizes"), i) + x["head"]).alias("start"),
                                                   x["body"].alias("length"), x["loss"].alias("loss")))
    blocks = blocks.select("leaf", F.struct("block", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
                                            F.filter(spans, lambda s: s["loss"]).alias("spans")).alias("b"))
    whole = blocks.groupBy("leaf").agg(F.sort_array(F.collect_list("b")).alias("b"))
    whole = whole.withColumn("sizes", F.transform("b", lambda x: F.octet_length(x["text"])))
    moved = F.transform("b", lambda x, i: F.transform(x["spans"], lambda s: F.struct(
        (s["start"] + total(F.col("sizes"), i)).alias("start"), s["length"].alias("length"))))
    return whole.select("leaf", F.array_join(F.transform("b", lambda x: x["text"]), "").alias("formatted"),
                        F.flatten(moved).alias("loss_spans"))


def read_back(formatted: str = "formatted", loss_spans: str = "loss_spans") -> tuple[Column, Column]:
    """(turns: array of (role, text), all text under the loss mask) from the output alone."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, ">", 1), len(OPEN) + 1, 1 << 30)).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, ">", 1)) + 2, F.lit(1 << 30))).alias("text")))
    raw = F.col(formatted).cast("binary")
    masked = F.transform(loss_spans, lambda s: unescaped(F.substring(raw, s["start"] + 1, s["length"]).cast("string")))
    return turns, F.array_join(masked, "")


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant", folder: str | None = None) -> DataFrame:
    """(leaf, rank, formatted, loss_spans) from (node, parent, score, role, text): one row per
    chosen branch.  ``node`` is unique; a null ``parent`` is a root."""
    folder = folder or work_dir(messages.sparkSession, "reply-trees")
    clean = messages.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    replies = messages.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    paths = written(chosen_paths(replies, folder, branches), f"{folder}/chosen")
    ranks = paths.where("node = leaf").select("leaf", "rank")
    return formatted_paths(paths, clean, loss_role).join(ranks, "leaf")


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans for linear conversations (conv_id, turn, role, text):
    each message replies to the one before it."""
    folder = work_dir(conversations.sparkSession, "conversations")
    messages = written(conversations.select(
        F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("node")),
        f"{folder}/messages")
    order = messages.select("tree", "node", "turn", "role", F.xxhash64("text").alias("hash"))
    parents = written(chained(order, ["turn", "role", "hash"]), f"{folder}/parents")
    trees = messages.join(parents, "node").withColumn("score", F.lit(0.0))
    out = format_trees(trees, 1, loss_role, folder)
    return out.join(messages.select(F.col("node").alias("leaf"), F.col("tree").alias("conv_id")), "leaf").select(
        "conv_id", "formatted", "loss_spans")


def conversation_digests(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from
    the formatted conversations."""
    turns, loss = read_back()
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = format_conversations(conversations, loss_role).withColumns({"turns": turns, "loss": loss})
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
