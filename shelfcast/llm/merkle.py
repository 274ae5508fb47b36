"""Merkle manifest of a table: leaves, roots, and a proof for each row, by time-forward processing.

Leaves of a source stand in the order of their ids; three consecutive nodes make a parent, and the
sources' roots are the leaves of a last tree of the same form. Every node has a label, (level, place),
and children have smaller labels than their parents.

*Forwards in time.* A priority queue ordered by label carries digests to parents: the smallest label is
taken, its children's digests are hashed, and the result is sent to its parent. *Backwards*, a second
sweep from the root takes nodes by falling label and sends each child what its parent knows of the way
up, with the child's own siblings before it; what arrives at a leaf is its proof.

The queue is external. Inside a group of consecutive nodes (729, six levels) it is a heap in a task;
a message to a node of a later group is a row of a table in the shared folder, sorted by Spark into
the order of labels. So a tree of any size takes one round for each six levels, no task holds more
than a group, and a source with a third of all rows is many groups. Places come from sorted ranges
and the counts of each range, not from a window over a source.

A proof is text: levels from the leaf up, joined by commas, each the siblings' digests with ``*`` in
the place of the node itself. A lone leaf under a root of its own has the empty proof.

Defined results: ids sort with nulls first, rows with the same id by their leaf; equal rows are equal
leaves, each with its place. An empty table has no rows and no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from shelfcast.session import settle

FAN = 3
#: Levels of a group of nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- leaves ----------------------------------------------------------------------------


def encoded(value: Column) -> Column:
    """A field as ``-`` if it is null, else its UTF-8 byte count, ``:`` and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


# ---- places ----------------------------------------------------------------------------


def _count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of sorted rows and the place of each among its tree's rows in that part."""
    part, tree, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for name in batch.column("tree").to_pylist():
            at = at + 1 if name == tree else 0
            tree = name
            places.append(at)
        columns = {n: batch.column(n) for n in batch.schema.names}
        yield pa.RecordBatch.from_pydict(columns | {"part": pa.array([part] * len(places), pa.int32()), "local": pa.array(places, pa.int64())})


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column ``tree``) and ``place``, from 0 in each tree in the given order.

    Ranges are sorted and counted off one by one; only the first tree of a range can have begun in an
    earlier one, so there is at most one row to look up for each range.
    """
    # Equal rows can fill more than one range if something tells them apart; once written, it stays.
    rows = settle(rows.withColumn("tie", F.monotonically_increasing_id()))
    by = ["tree", *order, "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")
    schema = StructType([*ranges.schema.fields, StructField("part", IntegerType()), StructField("local", LongType())])
    counted = settle(ranges.mapInArrow(_count_off, schema))
    counts = counted.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begun = counts.select(F.col("part").alias("_part"), F.col("tree").alias("_tree"), F.sum("n").over(earlier).alias("_before"))
    found = counted.join(F.broadcast(begun.where("_before > 0")), (F.col("part") == F.col("_part")) & (F.col("tree") == F.col("_tree")), "left")
    return found.withColumn("place", F.col("local") + F.coalesce("_before", F.lit(0))).drop("part", "local", "_part", "_tree", "_before")


# ---- a group of nodes ------------------------------------------------------------------


def levels_of(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels


def sweep_up(digests: Sequence[str], levels: int) -> list[list[str]]:
    """The digests of a group's nodes, level by level, from the queue of messages to parents."""
    queue = [(0, place, digest) for place, digest in enumerate(digests)]
    tree: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, place = queue[0][:2]
        # At a leaf the message is its digest; at other nodes the digests of its children.
        inbox = []
        while queue and queue[0][:2] == (level, place):
            inbox.append(heapq.heappop(queue)[-1])
        digest = inbox[0] if level == 0 else hashlib.sha256("".join(inbox).encode()).hexdigest()
        tree[level].append(digest)
        if level < levels:
            # Children arrive in the order of their places.
            heapq.heappush(queue, (level + 1, place // FAN, place, digest))
    return tree


def sweep_down(tree: Sequence[Sequence[str]], suffix: str) -> list[str]:
    """The proofs of a group's nodes, from what is known above the group."""
    top = len(tree) - 1
    queue = [(-top, 0, suffix)]
    proofs = [""] * len(tree[0])
    while queue:
        level, place, known = heapq.heappop(queue)
        if level == 0:
            proofs[place] = known
            continue
        below = tree[-level - 1]
        run = range(FAN * place, min(FAN * (place + 1), len(below)))
        for child in run:
            own = "".join("*" if s == child else below[s] for s in run)
            heapq.heappush(queue, (level + 1, child, f"{own},{known}" if known else own))
    return proofs


def _group_tree(digests: Sequence[str], group: int, levels: int) -> list[list[str]]:
    """All levels of a group. The only group of a tree ends at its root; one of several goes up all
    ``levels``, however few nodes the last of them has."""
    return sweep_up(digests, levels_of(len(digests)) if group == 0 else levels)


def _group_top(rows: pa.Table, levels: int) -> pa.Table:
    digests, group = rows.sort_by("place").column("digest").to_pylist(), rows.column("group")[0].as_py()
    top = _group_tree(digests, group, levels)[-1]
    return pa.table({"tree": rows.column("tree")[:1], "place": rows.column("group")[:1], "digest": pa.array(top, pa.string())})


def _grouped(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("group", F.floor(F.col("place") / FAN**levels).cast("long"))


def rounds_up(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """(tree, place, digest) of the nodes of every ``levels``-th level, the last one a root for each tree.

    The first is ``nodes`` itself.
    """
    rounds = [nodes]
    while not rounds[-1].where("place > 0").isEmpty():
        groups = _grouped(rounds[-1].select("tree", "place", "digest"), levels).groupBy("tree", "group")
        rounds.append(settle(groups.applyInArrow(lambda rows: _group_top(rows, levels), "tree string, place long, digest string")))
    return rounds


def _deliver(key: tuple, nodes: pa.Table, above: pa.Table, names: list[str], levels: int) -> pa.Table:
    nodes = nodes.sort_by("place")
    group, suffix = key[1].as_py(), above.column("suffix")[0].as_py()
    tree = _group_tree(nodes.column("digest").to_pylist(), group, levels)
    proofs = pa.array(sweep_down(tree, suffix), pa.string())
    head = above.column("root")[0].as_py()
    return pa.table({n: nodes.column(n) for n in names} | {"proof": proofs, "root": pa.array([head] * nodes.num_rows, pa.string())})


def rounds_down(rounds: Sequence[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The first table of ``rounds`` with ``proof`` and ``root``, from (tree, suffix, root) of each tree.

    A proof leads to the tree's root and from there along the tree's suffix.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("group"), "suffix", "root")
    if len(rounds) == 1:
        # Each tree is a lone leaf.
        return rounds[0].join(known.select("tree", F.col("suffix").alias("proof"), "root"), "tree")
    for nodes in reversed(rounds[1:-1]):
        found = _delivered(nodes, known, levels)
        known = settle(found.select("tree", F.col("place").alias("group"), F.col("proof").alias("suffix"), "root"))
    return _delivered(rounds[0], known, levels)


def _delivered(nodes: DataFrame, known: DataFrame, levels: int) -> DataFrame:
    names = nodes.columns
    schema = StructType([*nodes.schema.fields, StructField("proof", StringType()), StructField("root", StringType())])
    groups = _grouped(nodes, levels).groupBy("tree", "group").cogroup(known.groupBy("tree", "group"))
    return groups.applyInArrow(lambda key, rows, above: _deliver(key, rows, above, names, levels), schema)


# ---- the manifest ----------------------------------------------------------------------


def manifest(leaves: DataFrame, source: str, order: Sequence[str], digest: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """``leaves`` with ``subroot`` of its source, ``root`` of all, and ``proof`` from the leaf to the root.

    ``digest`` is the column of leaf digests; leaves of a source stand in ``order``, then by digest.
    """
    # Null sources first, then bytewise; a tree's name is never null.
    tree = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    payload = F.struct(*[F.col(c) for c in leaves.columns if c != digest]).alias("payload")
    keys = {f"by_{i}": F.col(c) for i, c in enumerate(order)}
    rows = leaves.select(tree.alias("tree"), *[c.alias(n) for n, c in keys.items()], F.col(digest).alias("digest"), payload)
    rounds = rounds_up(placed(rows, [*keys, "digest"]).select("tree", "place", "digest", "payload"), levels)
    # The sources' roots are the leaves of one more tree.
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = rounds_up(placed(subroots, ["name"]).select("tree", "place", "digest", "name"), levels)
    top = upper[-1].select("tree", F.lit("").alias("suffix"), F.col("digest").alias("root"))
    # Subroot and root travel as one text, once for each group of nodes.
    pair = F.concat_ws(" ", "digest", "root").alias("root")
    above = rounds_down(upper, top, levels).select(F.col("name").alias("tree"), F.col("proof").alias("suffix"), pair)
    found = rounds_down(rounds, settle(above), levels)
    both = F.split("root", " ")
    return found.select("payload.*", F.col("digest").alias(digest), both[0].alias("subroot"), both[1].alias("root"), "proof")


def siblings(proof: Column) -> Column:
    """The digests of a proof, from the leaf up and left to right, as one text."""
    return F.translate(proof, ",*", "")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf digest leads to along a proof."""
    levels = F.when(proof == "", F.array().cast("array<string>")).otherwise(F.split(proof, ","))
    return F.aggregate(levels, digest, lambda below, level: F.sha2(F.replace(level, F.lit("*"), below), 256))


def verified(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents`` (doc_id, source, lang, n_chars, text), and whether each row's proof
    leads to the root after the texts of half the ids lost their line breaks."""
    fields = {n: F.col(n) for n in FIELDS}
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = {**fields, "text": F.translate("text", "\n", "")}
    leaves = documents.select(
        "doc_id",
        "source",
        leaf(list(fields.values())).alias("leaf"),
        F.when(even & F.contains("text", F.lit("\n")), leaf(list(changed.values()))).alias("seen"),
    )
    rows = manifest(leaves, "source", ["doc_id"])
    again = folded(F.coalesce("seen", "leaf"), F.col("proof"))
    checked = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), again.alias("folded_root")
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
