"""Conversation prefix trie by adaptive radix trees.

A turn (role and text) has an id of 16 bytes, the head of a SHA-256; the key of
a conversation is its turns' ids in a row. Keys sorted as bytes are sorted as
paths of the trie, so contiguous ranges of distinct keys are dealt to the
tasks, whatever many keys share. Each task builds adaptive radix trees of at
most ``CHUNK_KEYS`` keys, walks them bottom-up and emits a node at each byte
depth that is a whole number of turns. A node that may also occur in the
neighbouring tree (its depth is at most the turns that the border keys have in
common) is emitted as a partial row; all figures are additive over trees:

* a node and its place among its parent's children are counted by the first
  tree that has it;
* a key is a leaf if the next key, in whichever tree, does not start with it;
* saved tokens are the sum of members times text length of all partial nodes
  below, less the text length of every node counted once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import broadcast_if_small, partitions, written
from ledgerlake.llm.radix_tree import RadixTree, shared
from ledgerlake.llm.textkit import release

WIDTH = 16
CHUNK_KEYS, CHUNK_BYTES = 20_000, 8 << 20
#: conv_ids of one key meet in groups of ids that differ in the low bits only.
ID_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
GROUP, HEAD = 100, 6


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<id, size>>: one row per conversation.

    Conversation c gets the first h = crc32(c) % 6 turns of conversation
    c - c % 100 (fewer if it has fewer, none if there is none), then its own
    turns after the first h. Turns are ordered by ``turn``, null first; turns of
    equal place by their id, a repeated row stays a turn of its own. A null role
    or text is empty. Rows without conv_id belong to no conversation and are
    left out. % keeps the sign of c, as in SQL. Other columns are not read. Only
    ids and lengths are shuffled, once, by c - c % 100, which at most 199
    conversations have in common; one conversation must fit a task's memory.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % GROUP).alias("base"), F.struct(
            F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"),
            turn_id(role, text).alias("id"), F.char_length(text).alias("size")).alias("t"))
    own = rows.repartition(partitions(conversations.sparkSession), "base").groupBy("base", "conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEAD - 1))).over(Window.partitionBy("base"))
    rest = F.when(F.size("own") > h, F.slice("own", h + 1, F.size("own"))).otherwise(F.slice("own", 1, 0))
    given = own.withColumn("head", F.coalesce(head, F.slice("own", 1, 0)))
    return given.select("conv_id", F.concat(F.slice("head", F.lit(1), h), rest).alias("turns"))


def _keys(conversations: DataFrame) -> DataFrame:
    """key, sizes, n, least, ends of each distinct turn sequence, in key order over
    the partitions. Members' ids come packed, one row for 4,096 neighbouring ids,
    and stream through the digest in order."""
    long = conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"))
    some = long.groupBy("key", F.shiftright("conv_id", ID_BITS).alias("range")).agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    rows = some.repartitionByRange(partitions(conversations.sparkSession), "key").sortWithinPartitions("key", "range")
    schema = "key binary, sizes array<int>, n long, least long, ends string"
    arrow = pa.schema([("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, digest = None, None
        for b in batches:
            for r in b.to_pylist():
                if now is not None and r["key"] == now["key"]:
                    now["n"] += r["n"]
                    now["least"] = min(now["least"], r["least"])
                    digest.update(b"," + r["ids"].encode())
                    continue
                if now is not None:
                    out.append(now | {"ends": digest.hexdigest()})
                now, digest = {k: r[k] for k in ("key", "sizes", "n", "least")}, hashlib.sha256(r["ids"].encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*out, now | {"ends": digest.hexdigest()}], arrow)
        release()

    return rows.select("key", "sizes", "n", "least", "ids").mapInArrow(fold, schema)


def node_id(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def tree_nodes(keys: list[dict], before: bytes | None, after: bytes | None) -> list[dict]:
    """Nodes of one tree. ``keys``: distinct, sorted; ``before`` and ``after``: the
    keys next to them in other trees, if there are any.

    A row has ``id`` if the node is partial, and ``parent_id`` (partial parent) or
    ``parent`` (conv_id of a whole one), neither for the root.
    """
    tree = RadixTree()
    for k in keys:
        tree.insert(k["key"], k)
    first, last = keys[0]["key"], keys[-1]["key"]
    low = shared(before, first) // WIDTH if before is not None else -1
    high = shared(last, after) // WIDTH if after is not None else -1
    rows: list[dict] = []
    done: list[tuple] = []  # figures of finished siblings, the latest last
    for node, above, end, kids in tree.bottom_up():
        n = leaves = spent = once = tops = 0
        least, waiting, some = None, [], None
        below = done[len(done) - kids:]
        del done[len(done) - kids:]
        for k in below:
            n, leaves, spent, once, tops = n + k[0], leaves + k[1], spent + k[2], once + k[3], tops + k[4]
            least = k[5] if least is None else min(least, k[5])
            waiting += k[6]
            some = k[7]
        ends = None
        if (v := node.value) is not None:
            n, ends, some = n + v["n"], v["ends"], v
            least = v["least"] if least is None else min(least, v["least"])
            if not kids and not (v["key"] == last and high * WIDTH >= end):
                leaves += 1
        for depth in range(end // WIDTH, above // WIDTH, -1):
            at = depth * WIDTH
            prefix = some["key"][:at]
            early = depth <= low and first.startswith(prefix)
            partial = early or depth <= high and last.startswith(prefix)
            size = some["sizes"][depth - 1] if depth else 0
            spent, once = spent + size * n, once + (0 if early else size)
            row = {"id": node_id(prefix) if partial else None, "depth": depth, "conv_id": least, "n_convs": n, "n_children": tops,
                   "n_leaves": leaves, "saved_tokens": spent - once, "ends": ends if at == end else None, "parent": None, "parent_id": None}
            for i in waiting:
                rows[i]["parent_id" if partial else "parent"] = row["id"] if partial else least
            tops, waiting = int(not early), [len(rows)]
            rows.append(row)
        done.append((n, leaves, spent, once, tops, least, waiting, some))
    return rows


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of ``conversations`` (conv_id
    long, unique; turns array<struct<id, size>>): conv_id (least member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Without conversations there is no node.

    Partial nodes are a few per tree border; they meet by id, and nodes right
    below them get the parent's conv_id by a join with that table, broadcast
    only after its rows are counted.
    """
    spark = conversations.sparkSession
    keys = _keys(conversations).checkpoint()  # its partitions keep their numbers and order
    heads = sorted((r["p"], bytes(r["a"]), bytes(r["b"])) for r in keys.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("key").alias("a"), F.max("key").alias("b")).collect())  # two keys for each partition
    beside = {p: (heads[i - 1][2] if i else None, heads[i + 1][1] if i + 1 < len(heads) else None) for i, (p, _, _) in enumerate(heads)}
    shared_heads = spark.sparkContext.broadcast(beside)
    most_keys, most_bytes = CHUNK_KEYS, CHUNK_BYTES
    schema = ("id binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
              "ends string, parent long, parent_id binary")
    arrow = pa.schema([("id", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                       ("ends", pa.string()), ("parent", pa.int64()), ("parent_id", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared_heads.value.get(TaskContext.get().partitionId(), (None, None))
        chunk: list[dict] = []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                if len(chunk) >= most_keys or size >= most_bytes:
                    yield pa.RecordBatch.from_pylist(tree_nodes(chunk, before, r["key"]), arrow)
                    before, chunk, size = chunk[-1]["key"], [], 0
                chunk.append(r)
                size += len(r["key"])
        if chunk:
            yield pa.RecordBatch.from_pylist(tree_nodes(chunk, before, after), arrow)
        release()

    nodes = written(keys.mapInArrow(run, schema), "trie-nodes")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    met = written(nodes.where("id is not null").groupBy("id").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures],
        F.max("ends").alias("ends"), F.max("parent").alias("parent"), F.max("parent_id").alias("parent_id")), "trie-borders")
    every = nodes.where("id is null").unionByName(met).drop("id")
    above = broadcast_if_small(met.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("met")), 100_000)
    return every.join(above, "parent_id", "left").select(
        "conv_id", "depth", F.coalesce("parent", "met").alias("parent_conv_id"), *figures,
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
