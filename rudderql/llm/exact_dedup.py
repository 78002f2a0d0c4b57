"""Exact dedup with a heavy-hitter split.

1. Each row gets the SHA-256 of its text without ASCII white space; digests
   go to a narrow table in the shared folder, so texts are read once.
2. Misra-Gries: every partition keeps at most ``counters`` digests; the merged
   estimates fall short of the truth by at most rows / (counters + 1) in total,
   so every digest with more than ``rows / frequent`` rows is a candidate.
   Candidates number less than 2 * ``frequent`` whatever the input.
3. An exact map-side-combined aggregate verifies candidates and finds their
   winners; that bounded table is broadcast, so heavy digests never shuffle.
4. All other digests, each below rows / frequent, use the ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, text_of


def misra_gries(values: Iterator, k: int) -> dict:
    """At most ``k`` counters; a value's count is short by at most n / (k + 1).

    Works on batches: counts are added, and when there are more than k the
    (k + 1)-th largest is taken off all, which keeps that bound.
    """
    kept: Counter = Counter()
    for batch in values:
        kept.update(batch)
        if len(kept) > k:
            cut = sorted(kept.values(), reverse=True)[k]
            kept = Counter({d: n - cut for d, n in kept.items() if n > cut})
    return kept


def digests(docs: DataFrame) -> DataFrame:
    body = text_of()
    return docs.select("doc_id", F.length(body).cast("long").alias("n"), F.unhex(F.sha2(F.regexp_replace(body, SPACE, ""), 256)).alias("digest"))


def _winner() -> list:
    # Largest n, then smallest doc_id; a null doc_id only if there is no other.
    best = F.max(F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg")))
    return [best.alias("best"), F.count(F.lit(1)).alias("group_size")]


def exact_dedup(docs: DataFrame, frequent: int = 1000, counters: int = 2000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest (binary): one row for every input row.

    Null and empty texts are the same text. Of equal texts the row with the
    most code points, then the smallest doc_id stays. Rows that repeat both
    text and doc_id all count in group_size and are all marked kept when their
    doc_id wins (they are one document). A null doc_id wins only among nulls.
    Empty table: empty result. Other columns are ignored.
    """
    rows = materialize(digests(docs), "digests")

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = misra_gries((Counter(b["digest"]) for b in batches), counters)
        yield pd.DataFrame({"digest": list(kept.keys()), "n": list(kept.values())})

    total = rows.count()
    least = total / frequent - total / (counters + 1)
    sketch = rows.select("digest").mapInPandas(summary, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    candidates = sketch.where(F.col("n") > least).select("digest")
    verified = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*_winner())
    heavy = materialize(verified.where(F.col("group_size") * frequent > total), "heavy")
    light_rows = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    light = light_rows.groupBy("digest").agg(*_winner())
    done = rows.join(F.broadcast(heavy), "digest").unionByName(light_rows.join(light, "digest"))
    keep = F.when(F.col("best.known"), -F.col("best.neg"))
    return done.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")
