"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_format, read_back, unescaped
from .common import materialize, new_path, table, text_of
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_classes
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import plan_mix
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import STRONG, secret_scan
from .sql import ORACLES
from .token_rollup import TokenRollup, deletes, inserts, revisions, token_counts


def _sha(s: Column) -> Column:
    return F.sha2(s, 256)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, revise the counts of texts cleaned of table bars, purge texts under ten words; batches are sent again."""
    docs = table(spark, sf_dir, "documents")
    version = lambda n, text, last: F.struct(F.lit(n).alias("version"), text.alias("text"), last.alias("last"))
    barred, cleaned = F.contains(text_of(), F.lit("|")), F.translate(text_of(), "|", " ")
    versions = F.explode(F.when(barred, F.array(version(0, text_of(), F.lit(False)), version(1, cleaned, F.lit(True)))).otherwise(F.array(version(0, text_of(), F.lit(True))))).alias("v")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "source", "lang", versions)
    rows = rows.select(F.struct("id", "mark", "v.version", "v.last").alias("doc_id"), "source", "lang", "v.text")
    counted = materialize(token_counts(rows).select("doc_id.*", "source", "lang", "tokenizer", "n_tokens"), "counts")
    store = TokenRollup(spark, new_path(spark, "rollup"))
    # Both versions of a count are signed rows, so a revision needs no join.
    signed = counted.where("version = 1 or not last").withColumns({"was": F.when(F.col("version") == 0, F.col("n_tokens")), "now": F.when(F.col("version") == 1, F.col("n_tokens"))})
    short = counted.where("version = 0 and tokenizer = 'words-1' and n_tokens < 10").select(F.col("id").alias("short_id"), F.col("mark").alias("short_mark")).distinct()
    purged = counted.where("last").join(short, F.col("id").eqNullSafe(F.col("short_id")) & (F.col("mark") == F.col("short_mark")), "left_semi")
    batches = {"load": inserts(counted.where("version = 0")), "revise": revisions(signed, "was", "now"), "purge": deletes(purged)}
    for name in ("load", "revise", "load", "purge", "revise"):
        store.commit(name, batches[name])
    store.compact()
    store.commit("purge", batches["purge"])
    return store.totals()


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    base = [k for k, *_ in STRONG]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    strong = F.filter("spans", lambda x: x["kind"].isin(*base))
    weak = F.filter("spans", lambda x: ~x["kind"].isin(*base))
    return out.select("doc_id", *[number(k) for k in base], _sha(joined(strong)).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(weak).cast("long").alias("n_linked_weak"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


#: A conversation whose texts say the template's control strings.
PLANTED = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = chat_format(conv.unionByName(planted))
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
    cols = out.select("conv_id", turns.alias("turns"), "segments", "formatted", "valid").select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("under"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return cols.select("conv_id", "n_turns", _sha(F.col("said")).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), _sha(F.col("under")).alias("loss_sha256"), "formatted_chars", "valid")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", _sha(F.col("kept_text")).alias("kept_sha256"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_token_counts, op2_quality_rules, op3_best_fit_packing, op4_secret_scans, op5_ngram_jaccard_join, op6_chat_formatting, op7_exact_dedup, op8_license_scans, op9_line_dedup, op10_mixing_sources, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
