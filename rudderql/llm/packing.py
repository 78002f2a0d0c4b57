"""Best-fit packing into bins of several permitted sequence lengths.

Documents are cut into parts of at most the largest length, dealt by a seeded
hash into shards whose number grows with the input, and packed shard by shard,
largest part first. A part goes to the open bin that it leaves least room in.
If none has room, a bin is opened whose length costs least per token that it is
expected to hold: each permitted length is filled, on paper, with the parts
still waiting, and its cost is divided by what it held. At the end every bin is
downsized to the shortest permitted length that holds its contents. Only
(doc_id, copy, part, words) rows reach Python; a task holds one shard.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_words, text_of

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a bin of length c: c tokens of compute and a fixed overhead for each sequence.
OVERHEAD = 32
#: Shards are packed one after another in at most so many tasks.
TASKS = 10_000
COPIES = 100_000
SEED = 23


def _dry_fill(room: int, waiting: list[int], present: int) -> int:
    """Words that best fit would put into ``room``: again and again as many as fit of the longest waiting parts that fit."""
    left, at = room, room
    while left > 0 and (at := (present & ((1 << min(at, left) + 1) - 1)).bit_length() - 1) > 0:
        left -= at * min(waiting[at], left // at)
        at -= 1
    return room - left


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """bin and offset for each size (1 to max(lengths)) in descending order, and each bin's final length.

    Of bins with equally little room the one that came to it last is used, of
    lengths that cost equally little a word the shortest is opened.
    """
    lengths = sorted(lengths)
    waiting = np.bincount(np.asarray(sizes, dtype=np.int64), minlength=lengths[-1] + 1).tolist()
    present = sum(1 << n for n, c in enumerate(waiting) if c)  # bit n is set while a part of n words waits
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin with room r is open
    cap, free, bins, offsets = [], [], [], []
    for size in sizes:
        waiting[size] -= 1
        if not waiting[size]:
            present &= ~(1 << size)
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            allowed = lengths[bisect_left(lengths, size):]
            room = min(allowed, key=lambda c: ((c + OVERHEAD) / (size + _dry_fill(c - size, waiting, present)), c))  # noqa: B023
            b = len(cap)
            cap.append(room)
            free.append(room)
        bins.append(b)
        offsets.append(cap[b] - room)
        free[b] = room - size
        if free[b]:
            by_room.setdefault(free[b], []).append(b)
            rooms |= 1 << free[b]
    return bins, offsets, [lengths[bisect_left(lengths, c - f)] for c, f in zip(cap, free, strict=True)]


def text_mark(seed: int = SEED) -> Column:
    """What tells texts of one doc_id apart: ``mark`` of pack(), from the columns doc_id and text."""
    return F.xxhash64(F.lit(seed), "doc_id", text_of())


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_rows: int = 5_000, seed: int = SEED) -> DataFrame:
    """doc_id, mark, copy, part, start, n_words, bin_id, bin_offset, bin_length, bin_words: one row per part.

    A document's parts cover its words from 0 on, ``start`` being the first
    word's place; only its last part may be shorter than the largest length.
    Null, empty and blank texts have no words and thus no part. Rows that
    repeat a doc_id are documents of their own: ``mark`` (text_mark of the row)
    tells their texts apart, ``copy`` rows of equal doc_id and text. Ties are
    packed in order of hash, doc_id, copy and part. Empty table: empty result. Other columns are ignored.
    """
    top = max(lengths)
    if min(lengths) < 1:
        raise ValueError("lengths must be positive")
    sizes = docs.select("doc_id", text_mark(seed).alias("mark"), n_words(text_of()).alias("size")).where("size > 0")
    sizes = materialize(sizes, "lengths")
    shards = max(1, -(-sizes.count() // shard_rows))
    # Copies are counted and numbered anew in runs of COPIES, so a pair with a third of all rows is no task's alone.
    alike = sizes.groupBy("doc_id", "mark", "size").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("mark", "run")
    rows = alike.withColumn("copy", F.explode(F.sequence((F.col("run") * COPIES).cast("int"), (F.least("n", (F.col("run") + 1) * COPIES) - 1).cast("int"))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("mark", "copy"), F.lit(shards)).cast("int"))
    parts = rows.select("shard", "doc_id", "mark", "copy", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / top).cast("int"))).alias("part"))
    parts = parts.select("shard", "doc_id", "mark", "copy", "part", (F.col("part").cast("long") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("size") - F.col("part").cast("long") * top).alias("n_words"))

    def shard(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["n_words", "mark", "doc_id", "copy", "part"], ascending=[False, True, True, True, True], ignore_index=True)
        bins, offsets, final = pack_sizes(x["n_words"].tolist(), lengths)
        x["bin_id"] = x["shard"].astype(str) + "-" + pd.Series(bins, dtype="int64").astype(str)
        x["bin_offset"] = offsets
        x["bin_length"] = np.asarray(final, dtype=np.int64)[bins]
        x["bin_words"] = x.groupby("bin_id")["n_words"].transform("sum")
        return x[["doc_id", "mark", "copy", "part", "start", "n_words", "bin_id", "bin_offset", "bin_length", "bin_words"]]

    schema = "doc_id long, mark long, copy int, part int, start long, n_words long, bin_id string, bin_offset long, bin_length long, bin_words long"
    # By number, or adaptive execution would merge these few bytes, and with them the packing, into one task.
    return parts.repartition(min(shards, TASKS), "shard").groupBy("shard").applyInPandas(shard, schema)


def unpack_check(rows: Iterator[dict]) -> None:
    """Raise if bins overflow, overlap or have gaps; rows as of pack()."""
    by_bin: dict = {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append(r)
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["bin_offset"]):
            if r["bin_offset"] != at:
                raise ValueError(f"gap or overlap in {r['bin_id']}")
            at += r["n_words"]
        if at != parts[0]["bin_words"] or at > parts[0]["bin_length"]:
            raise ValueError(f"overfull {parts[0]['bin_id']}")
