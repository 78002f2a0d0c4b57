"""A training-data pipeline: each stage gets what the one before it kept.

Every stage takes and returns whole rows of documents (the last returns bins)
and reads only doc_id, text, lang and source; other columns, whatever their
names, travel along. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rudderql.llm.common import new_path, table
from rudderql.llm.jaccard_join import jaccard_classes
from rudderql.llm.line_dedup import line_dedup
from rudderql.llm.mixing import mix_texts
from rudderql.llm.packing import pack
from rudderql.llm.quality_rules import quality_rules
from rudderql.sources.shared import SharedFolder

#: Nothing in SQL states the seeded mix and the packing; tests/llm hold run() against brute force.
ORACLE_SQL = None


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents from ``row``, with ``kept_text`` as text and n_chars in step."""
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base and the certified cutoffs of their lang (null is a lang of its own).

    A null, empty or short text fails the base. Rows that repeat are judged
    alike. Without labels, or too few of them, the base alone decides.
    """
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; lines that five documents or more share stay in the largest doc_id that holds them.

    A null text becomes empty. Rows of one doc_id are one document; a row
    without doc_id counts as no document and keeps no shared line.
    """
    return _with_text(line_dedup(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays, with all of its rows.

    Texts without words have no near copies and stay. A row without doc_id
    stays if no row of its class has one.
    """
    stay = jaccard_classes(docs).where("first").select(F.col("doc_id").alias("k_id"), "mark")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keys = F.col("row.doc_id").eqNullSafe(F.col("k_id")) & F.xxhash64("row.text").eqNullSafe(F.col("mark"))
    return rows.join(stay, keys, "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each full pass over a document and one for the words drawn beyond; untaken documents go.

    A null source is a source of its own. Texts without words are never taken.
    Equal rows are alike and interchangeable. n_chars follows the text.
    """
    return _with_text(mix_texts(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins (see packing.pack) of all words; rows that repeat, or share or lack a doc_id, are documents of their own."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written to the shared folder, read again, and removed once the next one is there."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        paths.append(new_path(spark, name.replace(" ", "-")))
        stage(spark, docs, sf_dir).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
        for old in paths[:-1]:
            folder, _, last = old.rpartition("/")
            SharedFolder(spark, folder).remove(last)
    return docs
