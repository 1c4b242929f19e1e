"""The prefix trie of conversations, summed up along heavy paths.

rebuilt() gives every conversation the first turns of a shared one before its own; trie() makes one node of every
distinct sequence of first turns and adds up each node's subtree.

* A node's id is its depth and two 64-bit numbers, each the exclusive-or over its turns of a hash of (place, role,
  text). So a running exclusive-or gives every node of a conversation, a node's parent is its id without its last turn,
  and no text or sequence travels.
* Heavy paths: of each node's children the one with most members (ties: the smallest conversation) goes on its path. A
  light child has at most half of its parent's members, so no node is below more light edges than the logarithm of the
  number of conversations. A path ends in a leaf, and a leaf's smallest conversation names it: the path begins at the
  deepest light edge of that conversation, and its level is the number of its light edges, so both are aggregates over
  the conversation's nodes and no pointer is chased.
* Subtree sums: suffix sums along the paths of the deepest level; the sums of their heads are added up by parent and
  join the paths of the level above, one round a level.

Scale: turns are ordered by a range of (conversation, turn), so a conversation spans any number of partitions; running
totals along a conversation or path are taken in blocks of BLOCK places and joined by the totals of whole blocks. What
is broadcast is one row at most for each partition of the ordered turns. Nodes are joined by unique ids; the one join on
a repeated key (parents) is a plain sort-merge join, whose skewed side Spark splits. The conversations that end in one
node are joined in blocks of 65,536 ids; their digest is by its definition one stream, which a task reads block by block.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; null turns come first;
equal turns go by the first 64 characters of their role, then by a hash of role and text, and repeated rows are turns of
their own; conv_id % 100 keeps the sign of conv_id, as in SQL; a conversation without turns is a member of the root
alone; an empty table has no nodes. Extra columns are not read. Different sequences are one node with a chance of 2^-128
a pair.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.session import partitions, shared_dir, staged

SHARED, GROUP = 5, 100  # turns taken over at most; conversations that share their first turns
BLOCK = 4096
ENDS = 16  # bits of conversation ids in one block of a node's ends
ID, PARENT = ["depth", "p1", "p2"], ["parent_depth", "q1", "q2"]


def running(rows: DataFrame, key: str, place: str, totals: dict[str, str], xor: bool = False, backward: bool = False, long: bool = True) -> DataFrame:
    """rows with running totals ({new column: summed column}) along key by integer place; backward: from the last place on; long: there may be places of BLOCK or more."""
    over, of = (F.bit_xor, lambda a, b: a.bitwiseXOR(b)) if xor else (F.sum, lambda a, b: a + b)

    def along(*by: str) -> Window:
        w = Window.partitionBy(*by[:-1])
        return w.orderBy(F.desc(by[-1]) if backward else F.asc(by[-1]))

    block = F.floor(F.col(place) / BLOCK)
    inside = rows.withColumn("_block", block)
    for name, column in totals.items():
        inside = inside.withColumn(name, over(column).over(along(key, "_block", place)))
    # Keys of one block need nothing else.
    if not long:
        return inside.drop("_block")
    several = rows.filter(F.col(place) >= BLOCK).select(key).distinct()
    sums = rows.join(several, key, "left_semi").groupBy(key, block.alias("_block")).agg(*(over(column).alias(f"_{name}") for name, column in totals.items()))
    before = along(key, "_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_block", *(over(f"_{name}").over(before).alias(f"_{name}") for name in totals))
    joined = inside.join(sums, [key, "_block"], "left")
    for name in totals:
        joined = joined.withColumn(name, of(F.col(name), F.coalesce(f"_{name}", F.lit(0))))
    return joined.drop("_block", *(f"_{name}" for name in totals))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, n): turns numbered without gaps in the order of conversation and turn, hashes of role and text, length of the text."""
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashes = [F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1).cast("long"), "role", "text").alias("t2")]
    order = ["conv_id", "turn", "begin", "t1", "t2"]
    # The last key only deals equal rows over several ranges.
    turns = turns.select("conv_id", "turn", F.substring("role", 1, 64).alias("begin"), *hashes, F.length("text").cast("long").alias("n"), F.monotonically_increasing_id().alias("at"))
    dealt = turns.repartitionByRange(partitions(conversations.sparkSession), *order, "at").sortWithinPartitions(*order)
    rows = staged(dealt.select("conv_id", "t1", "t2", "n", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)))
    # One row for each part reaches the driver.
    sizes = sorted(map(tuple, rows.groupBy("part").count().collect()))
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    shifts = rows.sparkSession.createDataFrame([(part, begin - (part << 33)) for (part, _), begin in zip(sizes, before)], "part long, shift long")
    return rows.join(F.broadcast(shifts), "part").select("conv_id", (F.col("at") + F.col("shift")).alias("at"), "t1", "t2", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, size) of every rebuilt conversation, staged; its turns (conv_id, depth, last, z1, z2, n)); z1 and z2 hash place, role and text."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"), F.min("at").alias("begin"))
    convs = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    lender = F.expr(f"conv_id % {GROUP} = 0")
    lenders = sizes.filter(lender).select(F.col("conv_id").alias("base"), F.col("own").alias("there"), F.col("begin").alias("base_begin"))
    convs = convs.join(lenders.hint("merge"), "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = staged(convs.select("conv_id", "base", "h", "taken", "begin", "base_begin", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    own = turns.join(convs.select("conv_id", "h", "taken", "size", "begin"), "conv_id").withColumn("place", F.expr("at - begin + 1")).filter("place > h").withColumn("depth", F.expr("place - h + taken"))
    first = turns.filter(lender).select(F.col("conv_id").alias("base"), "at", "t1", "t2", "n").join(convs.filter(lender).select(F.col("conv_id").alias("base"), "begin"), "base").filter(f"at < begin + {SHARED}").drop("begin")
    lent = convs.filter("taken > 0").join(first, "base").withColumn("depth", F.expr("at - base_begin + 1")).filter("depth <= taken")
    columns = ["conv_id", "depth", F.expr("depth = size").alias("last"), F.xxhash64("depth", "t1").alias("z1"), F.xxhash64("depth", "t2").alias("z2"), "n"]
    return convs.select("conv_id", "size"), own.select(*columns).unionByName(lent.select(*columns))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (depth, p1, p2, slot, ids) sorted by node and slot: each node's SHA-256 of all its ids, joined by commas."""
    held, state = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*ID, "ids"))):
            if node == held:
                state.update(b"," + ids.encode())
            else:
                if held is not None:
                    out.append((*held, state.hexdigest()))
                held, state = node, hashlib.sha256(ids.encode())
        yield _ends(out)
    if held is not None:
        yield _ends([(*held, state.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*ID, "ends_sha256"])


def ends(members: DataFrame, parts: int) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of members (depth, p1, p2, conv_id) that end in a node."""
    blocks = members.groupBy(*ID, F.shiftright("conv_id", ENDS).alias("slot")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return blocks.repartition(parts, *ID).sortWithinPartitions(*ID, "slot").mapInArrow(_digested, "depth long, p1 long, p2 long, ends_sha256 string")


def _node_table(convs: DataFrame, walked: DataFrame) -> DataFrame:
    """Every node: id, smallest member, members, length of its last text, parent's id, children, and whether its edge is light; staged."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").selectExpr("0L as depth", "0L as p1", "0L as p2", "conv_id", "n_convs", "0L as n", "-1L as parent_depth", "0L as q1", "0L as q2")
    below = walked.groupBy(*ID).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n").alias("n"), F.min("z1").alias("z1"), F.min("z2").alias("z2"))
    nodes = staged(below.select(*ID, "conv_id", "n_convs", "n", (F.col("depth") - 1).alias("parent_depth"), F.expr("p1 ^ z1").alias("q1"), F.expr("p2 ^ z2").alias("q2")).unionByName(root))
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"), *ID))
    families = nodes.filter("depth > 0").groupBy(*(F.col(q).alias(p) for q, p in zip(PARENT, ID))).agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    heavy = families.select(*(F.col(f"heavy.{c}").alias(c) for c in ID), F.lit(False).alias("light"))
    out = nodes.join(families.drop("heavy"), ID, "left").join(heavy, ID, "left")
    return staged(out.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("light", F.expr("depth > 0 and light is null")))


def _heavy_paths(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """Each node once, with its path (the conversation of its leaf), the depth of the path's head, and the path's level; staged by level."""
    leaves = nodes.filter("n_children = 0").select(F.col("conv_id").alias("path"))
    own = walked.select(F.col("conv_id").alias("path"), *ID).join(leaves, "path", "left_semi")
    steps = staged(own.unionByName(leaves.selectExpr("path", "0L as depth", "0L as p1", "0L as p2")))
    light = steps.join(nodes.filter("light").select(*ID), ID).groupBy("path").agg(F.max("depth").alias("head"), F.count("*").alias("level"))
    # A path without light edges begins at the root.
    steps = steps.join(light.hint("merge"), "path", "left").withColumn("head", F.coalesce("head", F.lit(0).cast("long"))).withColumn("level", F.coalesce("level", F.lit(0).cast("long"))).filter("depth >= head")
    rows = steps.join(nodes, ID).select("path", "level", "head", *ID, *PARENT, "conv_id", "n_convs", "n_children", F.expr("cast(n_children = 0 as long)").alias("leaf"), F.expr("(n_convs - 1) * n").alias("saved"))
    target = f"{shared_dir(nodes.sparkSession)}/paths_{uuid.uuid4().hex}"
    rows.write.partitionBy("level").parquet(target)
    return nodes.sparkSession.read.schema(rows.schema).parquet(target)


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(ordered(conversations))
    # No path is longer than the conversation that names it.
    long = not convs.filter(F.col("size") >= BLOCK).isEmpty()
    walked = staged(running(staged(turns) if long else turns, "conv_id", "depth", {"p1": "z1", "p2": "z2"}, xor=True, long=long))
    nodes = _node_table(convs, walked)
    paths = _heavy_paths(nodes, walked)
    above = paths.agg(F.max("level")).first()[0] or 0
    levels: list[DataFrame] = []
    for level in range(above, -1, -1):
        rows = paths.filter(F.col("level") == level)
        if levels:
            heads = levels[-1].filter("depth = head").groupBy(*(F.col(q).alias(p) for q, p in zip(PARENT, ID))).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            rows = rows.join(heads.hint("merge"), ID, "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
        rows = running(rows, "path", "depth", {"n_leaves": "leaf", "saved_tokens": "saved"}, backward=True, long=long)
        levels.append(staged(rows) if level else rows)  # nothing is above the last level
    summed = levels[0]
    for rows in levels[1:]:
        summed = summed.unionByName(rows)
    over = walked.filter("last").select(*ID, "conv_id").unionByName(convs.filter("size = 0").selectExpr("0L as depth", "0L as p1", "0L as p2", "conv_id"))
    parents = nodes.filter("n_children > 0").select(*(F.col(p).alias(q) for p, q in zip(ID, PARENT)), F.col("conv_id").alias("parent_conv_id"))
    out = summed.join(ends(over, partitions(spark)), ID, "left").join(parents, PARENT, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", _or_empty(F.col("ends_sha256")))


def _or_empty(digest: Column) -> Column:
    return F.coalesce(digest, F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
