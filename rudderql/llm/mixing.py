"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Targets share all words by weight, no source above
``max_repeats`` times its size. The words of each source, its documents in a
seeded order, are one stream that is cut into blocks; all blocks of all sources
have the same number of words (the last one of a source may be shorter). One
common number of blocks goes to the sources by highest quotients v / (2 s + 1)
of their targets. A quota that exceeds the source is whole passes and a rest;
the rest goes to the source's shards by highest quotients of their blocks, and
in each shard a seeded circular run of blocks is drawn. So most documents are
taken whole or not at all, each document's words follow from a few numbers of
its shard, and blocks are never rows. Only (doc_id, source, size) rows move.
Sources, not documents, are ranked as a whole; shards within their source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, let, materialize, n_words, small, text_of


def sainte_lague(votes: DataFrame, by: list[str], order: list[Column], seats: str = "seats") -> DataFrame:
    """Add ``quota``: how many of the ``seats`` of its group each row with ``votes`` gets.

    Equal to handing out one seat at a time to the highest votes / (2 s + 1):
    a divisor a little above the proportional one gives a first allocation
    that this method passes through; only the seats between it and that of a
    divisor a little below, two a row at most, are ranked by quotient.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    v, keys = F.col("votes").cast("double"), list(votes.columns)
    sums = votes.withColumns({"v_sum": F.sum(v).over(group), "v_n": F.count(F.lit(1)).over(group)})
    at = lambda shift: F.when(F.col("v_sum") > 0, F.greatest(F.lit(0.0), F.floor(v * (F.col(seats) + shift * F.col("v_n")) / F.col("v_sum") + 0.5))).otherwise(F.lit(0.0)).cast("long")
    sums = sums.withColumns({"low": at(-0.5), "high": at(0.5)}).withColumn("missing", F.col(seats) - F.sum("low").over(group))
    seat = sums.withColumn("seat", F.explode(F.sequence(F.col("low"), F.greatest(F.col("low"), F.col("high")))))
    seat = seat.withColumn("quotient", F.when(F.col("seat") > F.col("low"), v / (2 * F.col("seat") - 1)))
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("quotient"), *order, "seat"))
    won = F.sum(F.when(F.col("quotient").isNotNull() & (F.col("rank") <= F.col("missing")), 1).otherwise(0))
    return seat.withColumn("rank", rank).groupBy(*keys, "low").agg((F.col("low") + won).alias("quota")).drop("low")


def targets(sources: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """source, source_size -> with weight and target (words, double).

    Sources by code point, null last, weigh ``weights`` in turn. With sources
    sorted by limit / weight those at their limit are a prefix, so one pass of
    running sums finds the level at which the rest shares by weight.
    """
    every = W.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    t = sources.withColumn("place", place)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    t = t.withColumn("ratio", F.col("source_size") / F.col("weight"))
    up = every.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({
        "free": F.sum("source_size").over(every) - max_repeats * F.coalesce(F.sum("source_size").over(up), F.lit(0)),
        "shares": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0)),
    })
    fits = max_repeats * F.col("source_size") * F.col("shares") >= F.col("free") * F.col("weight")
    t = t.withColumn("level", F.min(F.when(fits, F.struct("ratio", "place", "free", "shares"))).over(every))
    shared = F.struct("ratio", "place") >= F.struct("level.ratio", "level.place")
    target = F.when(shared, (F.col("level.free") * F.col("weight")).cast("double") / F.col("level.shares")).otherwise((max_repeats * F.col("source_size")).cast("double"))
    return t.select("source", "source_size", "weight", "place", target.alias("target"))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs, rounded down."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def source_quotas(sources: DataFrame, weights: Sequence[int], max_repeats: int, block: int) -> DataFrame:
    """source, source_size -> with target, unit (words of a block), passes and seats (blocks drawn beyond the passes).

    ``unit`` is ``block``, or less if the least target is under 200 blocks, so
    that rounding to blocks matters to no source.
    """
    every = W.partitionBy(F.lit(0))
    t = targets(sources, weights, max_repeats)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    t = t.withColumn("unit", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / 200))).cast("long"))
    t = t.withColumns({"n_blocks": F.greatest(F.lit(1).cast("long"), _div(F.col("source_size") + F.col("unit") - 1, F.col("unit"))), "votes": F.col("target") / F.col("unit"), "seats": F.round(F.sum("target").over(every) / F.col("unit")).cast("long")})
    quota = F.least("quota", F.col("n_blocks") * max_repeats)
    return sainte_lague(t, [], [F.col("place")]).select("source", "source_size", "target", "unit", _div(quota, F.col("n_blocks")).alias("passes"), F.pmod(quota, "n_blocks").alias("seats"))


def shard_draws(shards: DataFrame, seed: int) -> DataFrame:
    """name, shard, shard_size, unit, seats -> name, shard and where the shard lies in its source and what is drawn.

    ``off``: words of the source before the shard; ``first``: its first block,
    of ``n_blocks`` that begin in it; ``quota`` of them from ``begin`` on, in a
    circle, are drawn; ``lead``: whether the block before ``first``, which may
    reach into the shard, is drawn too.
    """
    ahead = W.partitionBy("name").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda words: _div(words + F.col("unit") - 1, F.col("unit"))
    t = shards.withColumn("off", F.coalesce(F.sum("shard_size").over(ahead), F.lit(0)).cast("long")).withColumn("first", upto(F.col("off")))
    t = materialize(t.withColumn("votes", upto(F.col("off") + F.col("shard_size")) - F.col("first")), "shards")
    n = F.greatest("votes", F.lit(1).cast("long"))
    t = sainte_lague(t, ["name"], [F.col("shard")]).withColumn("begin", F.pmod(F.xxhash64(F.lit(seed + 2), "name", "shard"), n))
    tail = F.when(F.col("votes") > 0, F.pmod(F.col("votes") - 1 - F.col("begin"), n) < F.col("quota"))
    t = t.withColumn("lead", F.coalesce(F.last(tail, ignorenulls=True).over(ahead), F.lit(False)))
    return t.select("name", "shard", "unit", "off", "first", F.col("votes").alias("n_blocks"), "quota", "begin", "lead")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, block: int = 64, seed: int = 17, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, times, spans, taken: one row per input row.

    ``times`` full passes and, once more, the word ranges ``spans`` (from, to;
    counted from 0, end exclusive, apart from each other) make up ``taken``
    words. ``carry`` adds ``row``, the whole input row. A null text has size 0
    and is never taken; null sources form a source of their own, last in order.
    Rows of equal doc_id and text are alike and interchangeable. No words at
    all: every target and taken is 0. Empty table: empty result.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null, and no other source, has the empty name
    body = text_of()
    sizes = docs.select("doc_id", "source", name.alias("name"), n_words(body).alias("size"), F.xxhash64(F.lit(seed), "doc_id", body).alias("order"), *row)
    narrow = materialize(sizes.select("doc_id", "source", "name", "size", "order"), "sizes")
    goals = source_quotas(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats, block)
    goal = small(materialize(goals.withColumn("name", name).drop("source"), "goals"))
    shards = max(1, math.isqrt(narrow.count()))  # rows of a shard and shards of a source both grow as the root of the input
    shard = F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int")
    per = narrow.groupBy("name", shard.alias("shard")).agg(F.sum("size").alias("shard_size")).where("shard_size > 0")
    given = shard_draws(per.join(goal.select("name", "unit", "seats"), "name"), seed).drop("unit")
    ahead = W.partitionBy("name", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = (sizes if carry else narrow).withColumn("shard", shard).withColumn("start", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    full = placed.join(given, ["name", "shard"], "left").join(goal, "name")
    times = F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("long")
    drawn = full.withColumns({"times": times, "spans": F.when((F.col("size") > 0) & F.col("quota").isNotNull(), _spans()).otherwise(F.array().cast(SPANS))})
    taken = F.col("size") * F.col("times") + _length("spans")
    return drawn.select("doc_id", "source", "size", "source_size", "target", "times", "spans", taken.alias("taken"), *(["row"] if carry else []))


SPANS = "array<struct<from: bigint, to: bigint>>"


def _spans() -> Column:
    """The document's word ranges in drawn blocks: the block that leads into its shard, the run's part after the turn, the run's begin."""
    first, begin, quota, n, unit = (F.col(c) for c in ("first", "begin", "quota", "n_blocks", "unit"))
    start = F.col("off") + F.col("start")
    cut = lambda a, b: F.struct((F.greatest(a * unit, start) - start).alias("from"), (F.least(b * unit, start + F.col("size")) - start).alias("to"))
    runs = F.array(
        cut(F.when(F.col("lead"), first - 1).otherwise(first), first),
        cut(first, first + F.greatest(F.lit(0), begin + quota - n)),
        cut(first + begin, first + F.least(begin + quota, n)),
    )
    return F.filter(runs, lambda x: x["to"] > x["from"]).cast(SPANS)


def _length(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """``row`` and ``kept_text``: a row for every full pass and one for the drawn words.

    Full passes keep the text as it is, drawn words are joined by a blank
    (all words drawn: the text as it is). A document of which nothing is
    taken gives no row. Nulls, ties and empty tables: as for plan_mix.
    """
    plan = plan_mix(docs, carry=True, **options).where(F.col("taken") > 0)
    text, spans = F.col("row.text"), F.col("spans")
    part = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.array_join(F.flatten(F.transform(spans, lambda x: F.slice(words, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")))), " "))
    once = F.when(F.size(spans) == 0, F.array().cast("array<string>")).when(_length("spans") == F.col("size"), F.array(text)).otherwise(F.array(part))
    return plan.select("row", F.explode(F.concat(F.array_repeat(text, F.col("times").cast("int")), once)).alias("kept_text"))
