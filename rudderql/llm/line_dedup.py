"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded with their normalised key, keys are hashed to 128 bits,
distinct documents are counted per hash (two-phase, so a key in a third of all
documents is combined before the shuffle), lines over the threshold are joined
back by hash and each text is put together again by line position. Only
(hash, doc_id) and (doc_id, position) rows and one copy of the texts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, let, materialize, text_of, two_hashes


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``row`` (the whole input row), n_lines, n_dropped, kept_text for every row.

    Null or empty text: one empty line, which is too short to be dropped.
    Rows with equal doc_id are one document for the count; rows of the largest
    doc_id keep the line, however often it occurs there. A null doc_id counts
    as no document and never keeps a line. Ties cannot occur beyond that. An
    empty table gives an empty result; other columns travel inside ``row``.
    """
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_of().alias("body"))
    mark = F.xxhash64("body").alias("mark")

    def keys(body: Column) -> Column:
        trimmed = F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS))), lambda x: F.length(x) >= min_chars)
        return F.array_distinct(F.transform(trimmed, ascii_lower))

    hashes = [h.alias(n) for h, n in zip(two_hashes(F.col("key")), ("h1", "h2"), strict=True)]
    counted = base.select("id", F.explode(keys(F.col("body"))).alias("key")).select("id", *hashes)
    common = counted.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    common = materialize(common, "common")  # so that the join below meets a plain table, and a hot key on its other side can be split

    lines = base.select("id", mark, F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).where(F.length(F.btrim("line", F.lit(SPACE_CHARS))) >= min_chars)
    hits = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).select("id", "mark", "pos", *hashes)
    lost = hits.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias("lost_id"), F.col("mark").alias("lost_mark")).agg(F.collect_set("pos").alias("lost"))

    marked = base.select("row", "id", "body", mark)
    joined = marked.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("mark") == F.col("lost_mark")), "left")
    total = F.regexp_count("body", F.lit("\n")) + 1
    left = F.array_except(F.sequence(F.lit(0), total - 1), F.col("lost"))
    rebuilt = let(F.split("body", "\n", -1), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        "row",
        total.cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("body")).otherwise(rebuilt).alias("kept_text"),
    )
