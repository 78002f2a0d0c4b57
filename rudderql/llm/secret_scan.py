"""Secret scans with multipart credential linking.

Strong patterns are secrets by themselves. Weak ones (an opaque token, an
account identifier, an endpoint) are reported only when complementary parts
lie within the same scope: the interval of ``reach`` code points around them.
Matches are taken within the row; match and gap lengths are exploded and
summed to spans, so just the few matches move. The interval join is a sweep:
sorted by position, each weak part needs only the nearest part of each class
before and after it, which is linear in the parts of a text; no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, class, pattern, group that is measured, its least length).
STRONG = (
    ("assign", "secret", ASSIGN, 2, 12),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", "secret", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
WEAK = (
    ("opaque", "secret", r"(?<![A-Za-z0-9+/])(?=[A-Z+/0-9]*[a-z])(?=[a-z+/0-9]*[A-Z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20,}", 0, 20),
    ("account", "identifier", r"""(?i:client|user|account|key)_?(?i:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 3),
    ("endpoint", "endpoint", r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?""", 0, 10),
)
KINDS = [k for k, *_ in STRONG + WEAK]


def _matches(body: Column, place: int, kind: tuple) -> Column:
    """For each match: kind's place, ordinal, text length before it since the last, its length, whether it counts."""
    _, _, pattern, group, least = kind
    gaps = F.split(body, pattern, -1)
    whole = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(measured, F.length).alias("m"))
    # Without a match there is one gap, the whole text; its row has no length and goes.
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(place).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), (x["m"] >= least).alias("fits")))
    return F.when(body.rlike(pattern), F.filter(rows, lambda x: x["n"].isNotNull()))


def secret_scan(docs: DataFrame, reach: int = 300) -> DataFrame:
    """doc_id, spans for each input row; spans: array of (kind, class, start, end, linked), sorted.

    Positions count code points from 0, ends are exclusive. Strong spans come
    always. A weak secret is reported if an identifier, a weak identifier if a
    secret, an endpoint if both lie within ``reach``; weak parts that overlap
    a strong span are that span's and are not repeated. ``linked`` says that
    complementary parts co-occur. Null or empty text: no spans. Rows that
    repeat doc_id and text get equal spans. Empty table: empty result; other
    columns are ignored.
    """
    body = text_of()
    kinds = STRONG + WEAK
    keyed = docs.select("doc_id", F.xxhash64(body).alias("mark"), body.alias("body"))
    found = keyed.select("doc_id", "mark", F.array_compact(F.array(*[_matches(F.col("body"), i, k) for i, k in enumerate(kinds)])).alias("found")).where(F.size("found") > 0)
    rows = found.select("doc_id", "mark", F.explode(F.flatten("found")).alias("m")).select("doc_id", "mark", "m.*").dropDuplicates(["doc_id", "mark", "kind", "i"])
    run = W.partitionBy("doc_id", "mark", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    parts = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run)).where("fits").withColumn("start", F.col("end") - F.col("n"))
    classes = F.array(*[F.lit(c) for _, c, *_ in kinds])
    parts = parts.select("doc_id", "mark", "kind", F.get(classes, F.col("kind")).alias("class"), "start", "end", (F.col("kind") >= len(STRONG)).alias("weak"))
    text = W.partitionBy("doc_id", "mark").orderBy("start", "kind")
    before, after = text.rowsBetween(W.unboundedPreceding, -1), text.rowsBetween(1, W.unboundedFollowing)
    strong_end = F.max(F.when(~F.col("weak"), F.col("end"))).over(before)
    strong_start = F.min(F.when(~F.col("weak"), F.col("start"))).over(after)
    inside = F.col("weak") & (F.coalesce(strong_end > F.col("start"), F.lit(False)) | F.coalesce(strong_start < F.col("end"), F.lit(False)))
    parts = parts.withColumn("inside", inside).where(~F.col("inside"))

    def near(name: str) -> Column:
        is_it = F.col("class") == name
        last, first = F.max(F.when(is_it, F.col("end"))).over(before), F.min(F.when(is_it, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(first - F.col("end") <= reach, F.lit(False))

    parts = parts.withColumns({"near_id": near("identifier"), "near_secret": near("secret")})
    linked = F.when(F.col("class") == "secret", F.col("near_id")).when(F.col("class") == "identifier", F.col("near_secret")).otherwise(F.col("near_id") & F.col("near_secret"))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = parts.withColumn("linked", linked).where(~F.col("weak") | F.col("linked"))
    span = F.struct("start", "kind", "end", "class", "linked")
    spans = shown.groupBy(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark")).agg(F.sort_array(F.collect_list(span)).alias("s"))
    out = F.transform(F.coalesce("s", F.array().cast("array<struct<start: bigint, kind: int, end: bigint, class: string, linked: boolean>>")), lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["class"].alias("class"), x["start"].alias("start"), x["end"].alias("end"), x["linked"].alias("linked")))
    return keyed.drop("body").join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select("doc_id", out.alias("spans"))
