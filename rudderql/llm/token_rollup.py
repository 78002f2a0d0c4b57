"""Token counts as rollups that are maintained by signed deltas.

A change to a document is one or two signed rows: an insert adds (+1, +n), a
delete adds (-1, -n), a revised count adds (0, n' - n). A batch is combined to
a row per source, language and tokenizer version and committed once under its
identifier, however often it is sent:

1. the combined rows are written to ``staging/<batch>-<try>``;
2. a folder that names the try is renamed to ``seen/<batch>``. That is the
   commit; the name is taken for good, compaction never removes it;
3. the rows are renamed to ``live/<batch>``. If a writer is lost after 2, the
   next who sends the batch does this step for it.

``compact`` folds live batches into a snapshot that names exactly those it
holds, and only then removes them; what an interrupted run left is removed
before the next fold. So lists hold the batches since the last fold, not all.
Renaming to a name that exists must fail or nest, as on HDFS and local disks;
a store without that needs an outside lock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, text_of

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
#: Tokenizer version -> pattern of one token.
TOKENIZERS = {
    "words-1": WORD,
    "pieces-1": r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]+",
}


def token_counts(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS, text: Column | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row per input row and tokenizer version.

    A null or empty text has 0 tokens. Nulls in other columns stay. Repeated
    rows each get theirs; other columns are ignored; empty table: empty result.
    """
    body = text_of() if text is None else text
    counts = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.regexp_count(body, F.lit(p)).cast("long").alias("n_tokens")) for k, p in tokenizers.items()])
    return docs.select("doc_id", "source", "lang", F.explode(counts).alias("c")).select("doc_id", "source", "lang", "c.tokenizer", "c.n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    """A signed row per count (as of token_counts), repeated rows each; nulls in the key stay; empty in, empty out."""
    return counts.select(*KEY, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """What takes ``counts`` away again; n_tokens is the count as it stands. Nulls, repeats and empty tables: as inserts()."""
    return counts.select(*KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revisions(counts: DataFrame, before: str, after: str) -> DataFrame:
    """Changes of counts from column ``before`` to ``after``; a null count there is 0. Otherwise as inserts()."""
    change = F.coalesce(F.col(after), F.lit(0)) - F.coalesce(F.col(before), F.lit(0))
    return counts.select(*KEY, F.lit(0).cast("long").alias("d_docs"), change.cast("long").alias("d_tokens"))


class TokenRollup:
    """A rollup at ``path`` (any folder that Spark and Hadoop can write).

    Keys may be null and group like any value; empty batches commit and count
    as seen; totals of keys whose documents are all gone stay, as 0. Repeated
    rows of a batch all count. A reader whose files a compaction removes fails
    and can read again; it never gets other totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """All batch identifiers ever committed; for inspection, nothing here depends on this list."""
        return self._names("seen")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Combine and add a batch; False, and no change, if it is there already."""
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._":
            raise ValueError(f"not a batch identifier: {batch!r}")
        if self._there(f"seen/{batch}"):
            self._finish(batch)
            return False
        attempt = uuid.uuid4().hex
        combined = deltas.groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        combined.write.parquet(f"{self.path}/staging/{batch}-{attempt}")
        self._fs.mkdirs(self._hadoop(f"{self.path}/staging/mark-{attempt}/{attempt}"))
        won = self._place(f"staging/mark-{attempt}", f"seen/{batch}")
        self._finish(batch)
        if not won:
            self._remove(f"staging/{batch}-{attempt}")
        return won

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._sum(*self._state())

    def compact(self) -> None:
        """Fold the live batches into a new snapshot, then remove them. Safe to repeat after any failure, and beside commits."""
        snap, _ = self._state()
        for b in self._held(snap):
            self._remove(f"live/{b}")
        snap, batches = self._state()
        if not batches:
            return
        at = int(snap) + 1 if snap else 0
        staged = f"staging/snapshot-{uuid.uuid4().hex}"
        self._sum(snap, batches).withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"}).write.parquet(f"{self.path}/{staged}/rows")
        for b in batches:
            self._fs.mkdirs(self._hadoop(f"{self.path}/{staged}/held/{b}"))
        if self._place(staged, f"snapshots/{at:09d}"):
            for b in batches:
                self._remove(f"live/{b}")
            for old in self._names("snapshots")[:-2]:
                self._remove(f"snapshots/{old}")

    def _state(self) -> tuple[str, list[str]]:
        """The last snapshot ('' if none) and the live batches beyond it, both of one moment."""
        while True:
            snap = (self._names("snapshots") or [""])[-1]
            live, held = self._names("live"), set(self._held(snap))
            if snap == (self._names("snapshots") or [""])[-1]:  # batches go only after a newer snapshot has come
                return snap, [b for b in live if b not in held]

    def _sum(self, snap: str, batches: list[str]) -> DataFrame:
        parts = [f"{self.path}/live/{b}" for b in batches] + ([f"{self.path}/snapshots/{snap}/rows"] if snap else [])
        rows = self.spark.read.schema(DELTA).parquet(*parts) if parts else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))

    def _finish(self, batch: str) -> None:
        """Bring the rows of the try that won to ``live``, if that is still to do; by whoever comes first."""
        staged = f"staging/{batch}-{self._names(f'seen/{batch}')[0]}"
        if self._there(staged):
            self._fs.mkdirs(self._hadoop(f"{self.path}/live"))
            try:
                self._fs.rename(self._hadoop(f"{self.path}/{staged}"), self._hadoop(f"{self.path}/live/{batch}"))
            except Exception:
                if self._there(staged):  # else another has just done it
                    raise

    def _place(self, staged: str, final: str) -> bool:
        """Rename to a name that only one can take."""
        self._fs.mkdirs(self._hadoop(f"{self.path}/{final.rpartition('/')[0]}"))
        # rename() into a name that exists would nest there, so look first; where two writers race, what nests is none of its own and is removed.
        if not self._there(final) and self._fs.rename(self._hadoop(f"{self.path}/{staged}"), self._hadoop(f"{self.path}/{final}")):
            nested = f"{final}/{staged.rpartition('/')[2]}"
            if not self._there(nested):
                return True
            self._remove(nested)
        self._remove(staged)
        return False

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(f"{self.path}/{name}"))

    def _remove(self, name: str) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/{name}"), True)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _held(self, snap: str) -> list[str]:
        return self._names(f"snapshots/{snap}/held") if snap else []
