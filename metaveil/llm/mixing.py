"""Temperature mixing of sources: shares to an exponent, and the mixture as budgeted block permutations.

A source's share is its part of all tokens (words between white space). Its weight is its share to the power of an exponent,
normalised. The exponent lies between 0 (all sources alike) and 1 (as they are): the largest one whose weights have at least
the target entropy, unless a source would be repeated more than max_epochs times; then the smallest one that holds this limit.
Both are found by bisection in 64 parts: one small aggregation over the sources evaluates 63 exponents at once.

The budget is in tokens. Without one it is the least budget in which no source falls short of one whole pass, so that every
document is there at least once. A source's budget makes some whole passes and a part of one. Each pass (epoch) is a
permutation of the source's blocks, and of the documents in each: a hash of the document and the epoch deals documents to
blocks of about BLOCK_ROWS rows and orders them there. The part is the beginning of its permutation, as many documents as fit
into the rest of the budget. Running totals are taken over blocks and then within blocks, never over a whole source at once.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and go along with every pass, whole
or in part as their turn comes; sources without tokens have weight zero and one pass; rows that repeat a doc_id are documents
of their own; one source has weight 1 and one pass; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaveil.llm.common import SPACE, materialise, unused

BLOCK_ROWS = 1024
PARTS, TURNS = 64, 6
#: Whole passes and a part of one, of a source: rounding of doubles must not turn a whole pass into a part.
EXACT = 1e-9
#: Sources up to this many are broadcast, more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


@dataclass
class Target:
    """entropy: as a part of the largest possible, ln(sources). budget: in tokens, None for whole passes of all."""

    entropy: float = 0.9
    max_epochs: float = 4.0
    budget: int | None = None


def tokens(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+")), F.lit(0)).cast("bigint")


def _key(source: F.Column) -> F.Column:
    """A source's name as a join key: never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def totals(counted: DataFrame) -> DataFrame:
    """key, docs, tokens: one row for each source."""
    return counted.groupBy("key").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def _scan(sources: DataFrame, low: float, high: float, total: int) -> list[tuple[float, float, float, float]]:
    """(exponent, entropy, sum of powers, most of weight by share) at the inner points between low and high."""
    points = [low + (high - low) * k / PARTS for k in range(1, PARTS)]
    share = F.col("tokens") / total
    by = sources.where("tokens > 0").select(share.alias("p"), F.explode(F.array(*[F.lit(a) for a in points])).alias("a"))
    power = F.pow("p", F.col("a"))
    rows = by.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("r"))
    return sorted((r.a, math.log(r.z) - r.a * r.s / r.z, r.z, r.r / r.z) for r in rows.collect())


def exponent(sources: DataFrame, target: Target) -> float:
    """Between 0 and 1; sources: key, tokens."""
    n, total = sources.where("tokens > 0").agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0

    def bisect(holds_low) -> float:
        """The border between points that hold (towards 0) and those that don't."""
        low, high = 0.0, 1.0
        for _ in range(TURNS):
            found = _scan(sources, low, high, total)
            good = [p for p in found if holds_low(p)]
            low, high = (good[-1][0] if good else low), next((p[0] for p in found if not holds_low(p)), high)
            if high - low < 1e-9:
                break
        return low if high < 1.0 else 1.0

    wanted = target.entropy * math.log(n)
    by_entropy = bisect(lambda p: p[1] >= wanted)
    if target.budget is None:
        # the budget makes the least repeated source one pass: passes are weight by share over the least of these
        least = sources.where("tokens > 0").agg((F.max("tokens") / total).alias("p")).first().p
        repeats = lambda p: p[3] * p[2] / least ** (p[0] - 1)
    else:
        repeats = lambda p: p[3] * target.budget / total
    by_limit = bisect(lambda p: repeats(p) > target.max_epochs)
    return max(by_entropy, by_limit)


def plan(counted: DataFrame, target: Target) -> DataFrame:
    """key, docs, tokens, weight, budget (tokens), full (whole passes), rest (tokens of the part): one row for each source."""
    sources = materialise(totals(counted), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    a = exponent(sources, target)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / (total or 1), F.lit(a))).otherwise(0.0)
    z, passes = sources.agg(F.sum(power), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / power))).first()
    budget = (passes or 0.0) * (z or 0.0) if target.budget is None else float(target.budget)
    planned = sources.withColumn("weight", power / (z or 1.0)).withColumn("budget", F.col("weight") * budget)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + EXACT)).otherwise(1).cast("int")
    rest = F.greatest(F.floor(F.col("budget") - F.col("full") * F.col("tokens") + 0.5), F.lit(0)).cast("bigint")
    planned = planned.withColumn("full", full)
    return planned.withColumn("rest", F.when(F.col("budget") - F.col("full") * F.col("tokens") > EXACT * F.col("budget"), rest).otherwise(0))


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources, "key")


def _turn(epoch: F.Column) -> F.Column:
    """Where a document comes in a pass: evenly spread over the non-negative longs."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "check", epoch), 1)


def _block(turn: F.Column) -> F.Column:
    """The block of a turn: as many blocks as BLOCK_ROWS goes into the source's documents."""
    blocks = F.ceil(F.col("docs") / BLOCK_ROWS).cast("bigint")
    return F.floor(F.shiftrightunsigned(turn, 31) * blocks / F.lit(float(1 << 32))).cast("bigint")


def _counted(docs: DataFrame) -> DataFrame:
    text = F.col("`text`").cast("string")
    return docs.select(
        F.col("`doc_id`").cast("bigint").alias("doc_id"), _key(F.col("`source`")).alias("key"), tokens(text).alias("tokens"), F.xxhash64(text).alias("check")
    )


def _starts(dealt: DataFrame) -> DataFrame:
    """key, epoch, block, before, sum: the tokens of the blocks before it, and its own."""
    sums = dealt.groupBy("key", "epoch", "block").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("key", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))


def cuts(counted: DataFrame, planned: DataFrame) -> DataFrame:
    """planned with last: documents whose turn in the partial pass is at most last are in it (-1: none)."""
    part = _joined(counted, planned.where("rest > 0").select("key", "docs", "rest", F.col("full").alias("epoch")))
    part = part.withColumn("turn", _turn(F.col("epoch"))).withColumn("block", _block(F.col("turn")))
    part = materialise(part.select("key", "docs", "rest", "epoch", "tokens", "turn", "block"), "part")
    # the block in which the budget ends, or else the last one
    starts = _joined(_starts(part), planned.select("key", "rest")).where("before <= rest")
    edge = materialise(starts.groupBy("key").agg(F.max_by(F.struct("block", "before"), "block").alias("at")).select("key", "at.*"), "edge")
    inner = _joined(part, edge.withColumnRenamed("block", "edge")).where("block = edge")
    order = Window.partitionBy("key").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("tokens").over(order) <= F.col("rest")
    last = inner.withColumn("fits", fits).groupBy("key").agg(F.max(F.when(F.col("fits"), F.col("turn"))).alias("in"), F.min("turn").alias("first"))
    last = last.select("key", F.coalesce("in", F.col("first") - 1).alias("last"))
    return planned.join(last, "key", "left").withColumn("last", F.coalesce("last", F.lit(-1)))


def mixture(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """doc_id, source, epoch, block, start, n_tokens, weight, place: one row for each time that a document is in the mixture.

    start counts the source's tokens before it over all passes; place is start as a part of the source's budget: in order of
    place, any stretch of the mixture has the sources in their weights.
    """
    counted = materialise(_counted(docs), "counted")
    sources = materialise(cuts(counted, materialise(plan(counted, target or Target()), "planned")), "cuts")
    joined = _joined(counted, sources.withColumnRenamed("tokens", "pass"))
    passes = F.col("full") + (_turn(F.col("full")) <= F.col("last")).cast("int")
    dealt = joined.withColumn("epoch", F.explode(F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))))
    dealt = materialise(dealt.withColumn("turn", _turn(F.col("epoch"))).withColumn("block", _block(F.col("turn"))), "dealt")
    starts = materialise(_starts(dealt).drop("sum"), "starts")
    before = Window.partitionBy("key", "epoch", "block").orderBy("turn", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(starts, ["key", "epoch", "block"])
    start = F.col("epoch") * F.col("pass") + F.col("before") + F.col("within")
    return placed.select(
        "doc_id", F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), "epoch", "block", start.cast("bigint").alias("start"),
        F.col("tokens").alias("n_tokens"), "weight", F.when(F.col("budget") > 0, start / F.col("budget")).otherwise(0.0).alias("place"),
    )


def realise(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """The rows of docs (with doc_id, text and source), all their columns, as often as the mixture has them. Texts aren't shuffled."""
    counted = materialise(_counted(docs), "counted")
    sources = materialise(cuts(counted, materialise(plan(counted, target or Target()), "planned")), "cuts")
    mix, copy = unused(docs, "mix"), unused(docs, "copy")
    named = sources.select(F.struct("key", "full", "last").alias(mix))
    few = sources.count() <= BROADCAST_SOURCES
    check = F.xxhash64(docs["text"].cast("string"))
    turn = F.shiftrightunsigned(F.xxhash64(docs["doc_id"].cast("bigint"), check, F.col(f"{mix}.full")), 1)
    joined = docs.join(F.broadcast(named) if few else named, _key(docs["source"]) == F.col(f"{mix}.key"))
    passes = F.col(f"{mix}.full") + (turn <= F.col(f"{mix}.last")).cast("int")
    copies = F.when(passes > 0, F.sequence(F.lit(1), passes)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn(copy, F.explode(copies)).drop(mix, copy)
