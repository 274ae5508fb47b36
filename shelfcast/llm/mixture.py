"""Mixing sources to target weights by fitting a subset sum to each source's budget.

1. Documents are sized by their words, and counted for each source and exact size.
2. Every source gets a share of the total by its weight, at most ``most_copies`` times what it has;
   what the stopped sources leave is shared again by weight.
3. A source takes whole copies of itself while they fit. For the rest of its budget, a number of
   documents of each size is chosen: the same share of every size, rounded down or up by the largest
   remainder, and then, for the few words still missing, a bounded knapsack over the sizes left
   (dynamic programming on a bit set: every sum that can be reached). If the budget is not met, fewer
   sizes are rounded up and the knapsack gets more room.
4. Which documents of a size are taken is decided by a seeded hash of their ids.

The knapsack works on counts by size, not on documents.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.words import mix as mix_bits
from shelfcast.session import settle

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
# The knapsack looks this far. Words missing beyond it after the rounding, as only documents of more
# words than that leave them, are taken in whole documents, largest first.
REACH = 1 << 20
# The documents of one size are ranked in parts, by so many leading bits of their hash.
SHARE_BITS = 12

WORDS = r"[^\x20\x09-\x0D]+"


# ---- budgets ---------------------------------------------------------------------------


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of their code points, null last, have the weights in turn. The budgets are
    level * weight, stopped at most_copies * size, with the level at which they add up to the total:
    with the sources in the order in which they stop, the level after k stops is what is left over
    the weights that are left, and it holds for the first k whose next source does not stop. One row
    for each source goes through one window; nothing grows with the documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("stop", most_copies * F.col("source_size").cast("double"))
    stops = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "gone": F.coalesce(F.sum("stop").over(before), F.lit(0.0)),
            "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("gone")) / F.col("left"))
    free = F.col("level") * F.col("weight") <= F.col("stop")
    level = F.max(F.when(free, F.struct(-F.col("stop") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least(F.col("stop"), F.coalesce(level * F.col("weight"), F.col("stop")))
    return rows.select("source", "source_size", target.alias("target"))


# ---- the knapsack ----------------------------------------------------------------------


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that the sum comes nearest to the budget without passing it.

    Sizes are positive and distinct. The same share of every size is taken first, rounded; the
    bounded knapsack then fits what is missing. Its room starts at the largest size and grows to
    REACH until the budget is met.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    shares = [divmod(int(c) * budget, total) for c in counts.tolist()]
    down = np.array([d for d, _ in shares], np.int64)
    # The largest remainder first, equal ones in no order of size.
    ranks = mix_bits(sizes.astype(np.uint64)).tolist()
    order = [i for i in sorted(range(len(shares)), key=lambda i: (-shares[i][1], ranks[i])) if shares[i][1]]
    room = min(int(sizes.max()), REACH)
    while True:
        taken, missing = _rounded_up(sizes, counts, down, order, budget, room)
        taken = taken + _knapsack(sizes, counts - taken, missing)
        if room == REACH or int((sizes * taken).sum()) == budget:
            return taken
        room = min(8 * room, REACH)


def _rounded_up(
    sizes: np.ndarray, counts: np.ndarray, down: np.ndarray, order: list[int], budget: int, room: int
) -> tuple[np.ndarray, int]:
    """One document more of each size in turn until at most ``room`` words are missing; those are returned too."""
    taken, missing = down.copy(), budget - int((sizes * down).sum())
    for i in order:
        if missing <= room:
            break
        if sizes[i] <= missing:
            taken[i] += 1
            missing -= int(sizes[i])
    for i in np.argsort(-sizes):
        if missing <= REACH:
            break
        more = min(int(counts[i] - taken[i]), (missing - REACH) // int(sizes[i]))
        taken[i] += more
        missing -= more * int(sizes[i])
    return taken, missing


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming: bit s of ``reached`` says whether s can be made."""
    chosen = np.zeros_like(counts)
    window = (1 << (budget + 1)) - 1
    reached, layers = 1, []
    for i in np.argsort(-sizes).tolist():
        size, left, packs = int(sizes[i]), int(min(counts[i], budget // max(sizes[i], 1))), 1
        while left > 0 and not reached >> budget & 1:
            # Packs of 1, 2, 4, ... and a rest make any number up to the count.
            n = min(packs, left)
            grown = (reached | reached << (n * size)) & window
            if grown != reached:
                layers.append((i, n, reached))
                reached = grown
            left -= n
            packs *= 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    for i, n, before in reversed(layers):
        if not before >> at & 1:
            chosen[i] += n
            at -= n * int(sizes[i])
    return chosen


def _plan(rows: pa.Table, most_copies: int) -> pa.Table:
    """For each size of a source: whole copies of all its documents, and of how many one more."""
    target = rows.column("target")[0].as_py()
    size, n = rows.column("size").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
    total = int((size * n).sum())
    copies = min(int(target // total), most_copies) if total else 0
    more = np.zeros_like(n)
    if total and copies < most_copies:
        filled = np.flatnonzero(size > 0)
        more[filled] = fit_counts(size[filled], n[filled], int(round(target)) - copies * total)
    return pa.table(
        {
            "source": rows.column("source"),
            "size": rows.column("size"),
            "copies": pa.array(np.where(size > 0, copies, 0), pa.int64()),
            "more": pa.array(more, pa.int64()),
        }
    )


# ---- the mix ---------------------------------------------------------------------------


def size_of(text: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``sizes`` (doc_id, source, size and any others), which is read several times, with
    source_size, target and copies: how often the mix takes each.

    Defined results: sources are compared by code points, null is a source of its own and the last;
    a source without words has a target of 0; documents without words are never taken; of documents
    that share id, source and size, those that are taken are not told apart; reruns agree.
    """
    counts = settle(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    budgets = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most_copies)
    budgets = settle(budgets)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    known = counts.alias("c").join(budgets.alias("b"), same("c", "b")).select("c.source", "c.size", "c.n", "b.target")
    # A group has one row for each size of its source.
    plan = known.groupBy("source").applyInArrow(lambda t: _plan(t, most_copies), "source string, size long, copies long, more long")
    plan = settle(
        plan.alias("p").join(budgets.alias("b"), same("p", "b")).select("p.*", "b.source_size", "b.target")
    )

    # The documents of a size with the smallest hashes get one copy more. A size may hold a third
    # of all documents, so they are ranked within 4,096 parts of the hash; the parts before are counted.
    hashed = sizes.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id"))
    hashed = hashed.withColumn("share", F.shiftrightunsigned("hash", 64 - SHARE_BITS).cast("int"))
    keys = ["source", "size", "share"]
    per_share = hashed.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    per_share = per_share.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def matched(a: str, b: str, names: list[str]) -> Column:
        return functools.reduce(operator.and_, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])

    quota = (
        per_share.alias("s")
        .join(plan.alias("p"), matched("s", "p", ["source", "size"]))
        .select("s.source", "s.size", "s.share", (F.col("p.more") - F.col("s.before")).alias("quota"), "p.copies", "p.source_size", "p.target")
    )
    joined = (
        hashed.alias("h")
        .join(quota.alias("q"), matched("h", "q", keys))
        .select("h.*", "q.quota", "q.copies", "q.source_size", "q.target")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))
    copies = F.col("copies") + (rank <= F.col("quota")).cast("long")
    return joined.select(*sizes.columns, "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document. See ``mix``."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size"))
    # Read four times: the sizes are written once.
    return mix(settle(sizes))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, all columns kept, with ``copies``: how often it takes each.

    A column of that name is replaced.
    """
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns if n != "copies"]).alias("doc")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size"), whole)
    return mix(sizes).where("copies > 0").select("doc.*", "copies")
