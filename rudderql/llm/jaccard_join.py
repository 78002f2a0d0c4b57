"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed five-word shingles; equal sets are one node. A set
is embedded in ``T`` min-hash tokens (coordinate, value), of which two sets
share the fraction given by their Jaccard similarity. All nodes start in one
bucket. A bucket is split on sampled coordinates: the sample is a hash of the
path, so all members make the same choice, and each goes to the child of the
token that it has there. The root is split once for every run, a later bucket
on a few coordinates that its path has not used. Splitting goes on, without
a limit of depth, until a bucket is small or dense. Small buckets are compared
by brute force, and so are dense ones, whose members are nearly all alike and
which splitting would only repeat. Runs repeat until the chance to miss a pair
at the threshold is below 1 - ``recall``, at whatever depth its buckets end;
links are verified on the exact sets. In small buckets only pairs whose bitmaps
rule the threshold out are left unverified: a bound, not an estimate.

Each pair is compared in one bucket only, the first that both are in. A group
of near copies is dense in every run; dense buckets that share half of their
members with one and the same larger bucket are united with it, so such a group
is dealt out once, as pairs of blocks of bounded size. Buckets return link
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

N = 5
T = 64
SMALL = 100  # buckets of at most so many nodes are compared as they are
DENSE = 0.2  # chance that two members agree in two tokens, from which a bucket is dense
BLOCK_SHINGLES, BLOCK_NODES = 600_000, 1_000  # one side of a block pair has so many, about

_U = np.uint64
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, T, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, T, dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 63, N, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (fixed constants of the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of a shorter text its one run of all words."""
    words = text.split()  # of bytes: at the six ASCII white-space characters
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    if len(h) < N:
        return _mix((h * _STEP[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _U(len(h)))
    runs = h[: len(h) - N + 1] * _STEP[0]
    for k in range(1, N):
        runs = runs + h[k : len(h) - N + 1 + k] * _STEP[k]
    return np.unique(_mix(runs))


def min_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(T, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 2048):
        part = ((s[at : at + 2048, None] * _MUL + _ADD) >> _U(32)).astype(np.uint32)
        out = np.minimum(out, part.min(axis=0))
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for the low end of each hash, in words of 64; the bits are a power of two, two for each hash at least."""
    bits = np.zeros(max(64, 1 << (2 * len(s) - 1).bit_length()), dtype=bool)
    bits[s & _U(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for x in batch.column(name).cast(pa.large_binary()):
        yield x.as_py() or b""


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, mark, node (digest of the set, null if empty), n, sig, bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("bits", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, sig, bits = [], [], [], []
            for text in _texts(b):
                s = shingles(text)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(min_hashes(s).tobytes() if len(s) else None)
                bits.append(bitmap(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bits, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(make, "doc_id long, mark long, node binary, n long, sig binary, bits binary")


def _matrix(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(len(sig), T)


def _expand(samples: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(path, used, node, sig) -> (path, used, node, probe): the node in each of its buckets' sampled children.

    ``used`` has a bit for every coordinate on the path; ``probe`` is the
    node's tokens at two coordinates beyond, the same two for all of a bucket.
    """
    coordinate = np.arange(T, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            path, used, nodes, sig = b["path"].to_numpy().astype(np.uint64), b["used"].to_numpy().astype(np.uint64), b["node"].to_numpy(), _matrix(b["sig"]).astype(np.uint64)
            rank = _mix(path[:, None] ^ _mix(coordinate + _U(0x1234567))) >> _U(1)
            order = np.argsort(rank + ((used[:, None] >> coordinate & _U(1)) << _U(63)), axis=1)
            value = lambda k: np.take_along_axis(sig, order[:, k, None], 1)[:, 0]  # noqa: B023, E731
            probe = value(samples) << _U(32) | value(samples + 1)
            for k in range(samples):
                at = order[:, k].astype(np.uint64)
                child = _mix(path ^ _mix(value(k) + (at << _U(32)) + _U(1)))
                yield pd.DataFrame({"path": child.view(np.int64), "used": (used | _U(1) << at).view(np.int64), "node": nodes, "probe": probe.view(np.int64)})

    return run


def _onward(threshold: float, splits: int) -> float:
    """Chance, at least, that a pair at the threshold in a bucket below the root comes to a compared one, at any depth.

    It is the fixed point of q = 1 - (1 - threshold * q) ** splits; chances of
    finite depth fall towards it from 1.
    """
    q = 1.0
    for _ in range(1000):
        q = 1 - (1 - threshold * q) ** splits
    return q


def splits_needed(threshold: float) -> int:
    """Coordinates on which a bucket below the root is split: the fewest that lose at most a tenth, however deep."""
    return next((s for s in range(1, T) if _onward(threshold, s) >= 0.9), T)


def runs_needed(threshold: float, recall: float) -> int:
    """Runs (splits of the root) after which a pair at the threshold has been in a compared bucket with chance ``recall``."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold is above 0 and at most 1, recall between 0 and 1")
    one = threshold * _onward(threshold, splits_needed(threshold))  # it shares the token of the root's split, and goes on
    runs = 1 if one >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))
    if runs > T - 2:
        raise ValueError(f"{T} coordinates do not reach recall {recall} at {threshold}")
    return runs


def _grouped(key: list[str], handle: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable:
    """For mapInPandas over rows sorted by ``key``: calls ``handle`` with each group, also across batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            change = np.flatnonzero((b[key].to_numpy()[1:] != b[key].to_numpy()[:-1]).any(axis=1)) + 1
            cuts = [0, *change.tolist()]
            outs = [handle(b.iloc[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            if outs := [o for o in outs if o is not None]:
                yield pd.concat(outs, ignore_index=True)
            rest = b.iloc[cuts[-1] :]
        if rest is not None and len(rest) and (out := handle(rest)) is not None:
            yield out

    return run


def _met_before(order: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted lists of buckets share one before ``order``."""
    a, b = a[: np.searchsorted(a, order)], b[: np.searchsorted(b, order)]
    return bool(len(a) and len(b) and np.intersect1d(a, b, assume_unique=True).size)


def _possible(bits: list[np.ndarray], n: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i < j) that may reach the threshold, and all that do.

    A bit that one set has and the other has not stands for an element that
    is not shared. The longer of two bitmaps is folded to the length of the
    shorter, which holds for its set just as well.
    """
    width = np.array([len(x) for x in bits])
    out = np.zeros((len(n), len(n)), dtype=bool)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        other = np.flatnonzero((width >= w) & (threshold * n <= n[own].max() + 1e-9))
        folded = np.stack([np.bitwise_or.reduce(bits[i].reshape(-1, w), axis=0) for i in other])
        ones = np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
        step = max(1, 4_000_000 // folded.size)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            mine = np.searchsorted(other, some)
            both = np.bitwise_count(folded[mine, None, :] & folded[None, :, :]).sum(axis=2, dtype=np.int64)
            most = np.minimum(n[some, None] - ones[mine, None] + both, n[None, other] - ones[None, :] + both)
            out[np.ix_(some, other)] = most >= threshold * (n[some, None] + n[None, other] - most) - 1e-9
    return np.triu(out | out.T, 1)


def _candidates(threshold: float) -> Callable:
    """Of a small bucket the nodes with a possible partner that they first meet here."""
    def handle(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        n, leaves, order = g["n"].to_numpy(), g["leaves"].to_numpy(), int(g["leaf"].iloc[0])
        possible = _possible([np.frombuffer(x, dtype=np.uint64) for x in g["bits"]], n, threshold)
        active = np.zeros(len(g), dtype=bool)
        for i, j in zip(*np.nonzero(possible), strict=True):
            if not (active[i] and active[j]) and not _met_before(order, leaves[i], leaves[j]):
                active[[i, j]] = True
        return g.loc[active, ["leaf", "node"]] if active.any() else None

    return _grouped(["leaf"], handle)


def _links(threshold: float) -> Callable:
    """For a pair of blocks: each node's verified links that first meet here, and a node that it hangs together with.

    A block paired with itself compares all its pairs, else those across. A
    node's shingles are marked once and summed over the candidates, which are
    sorted by size, so lengths that cannot reach the threshold are skipped, and
    so are candidates that met the node in an earlier bucket.
    """
    def handle(g: pd.DataFrame) -> pd.DataFrame | None:
        sides, order = g["side"].to_numpy(), int(g["leaf"].iloc[0])
        within = g["i"].iloc[0] == g["j"].iloc[0]
        if len(g) < 2 or not (within or 0 < (sides == 1).sum() < len(g)):
            return None
        sets = [np.frombuffer(x, dtype=np.uint64) for x in g["shingles"]]
        leaves, nodes = g["leaves"].to_numpy(), g["node"].to_numpy()
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(size)])
        others = np.flatnonzero(sides == (0 if within else 1))
        others = others[np.argsort(size[others], kind="stable")]
        sorted_sizes = size[others]
        flat = np.concatenate([ids[at[i] : at[i + 1]] for i in others])
        begin = np.concatenate([[0], np.cumsum(sorted_sizes)])
        marked = np.zeros(int(ids.max()) + 1, dtype=np.int32)
        count, parent = np.zeros(len(g), dtype=np.int64), np.arange(len(g))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        early = [x[: np.searchsorted(x, order)] for x in leaves]
        before, where = np.unique(np.concatenate(early), return_inverse=True)
        met = np.zeros((len(g), len(before)), dtype=bool)  # node x earlier bucket
        met[np.repeat(np.arange(len(g)), [len(x) for x in early]), where] = True
        for a in np.flatnonzero(sides == 0):
            lo = np.searchsorted(sorted_sizes, math.ceil(threshold * size[a] - 1e-9))
            hi = np.searchsorted(sorted_sizes, math.floor(size[a] / threshold + 1e-9), side="right")
            due = others[lo:hi] > a if within else np.ones(max(0, hi - lo), dtype=bool)
            if len(early[a]) and due.any():
                due &= ~met[np.ix_(others[lo:hi], np.flatnonzero(met[a]))].any(axis=1)
            if not due.any():
                continue
            which = lo + np.flatnonzero(due)
            mine = ids[at[a] : at[a + 1]]
            marked[mine] = 1
            if 2 * len(which) > hi - lo:
                both = np.add.reduceat(marked[flat[begin[lo] : begin[hi]]], begin[lo:hi] - begin[lo])[which - lo]
            else:
                both = np.array([marked[flat[begin[k] : begin[k + 1]]].sum() for k in which])
            marked[mine] = 0
            alike = others[which][both >= threshold * (size[a] + sorted_sizes[which] - both) - 1e-9]
            if len(alike):
                count[a] += len(alike)
                count[alike] += 1
                top = root(a)
                for b in alike[parent[alike] != top]:
                    parent[root(b)] = top
        hit = np.flatnonzero(count)
        if not len(hit):
            return None
        return pd.DataFrame({"node": nodes[hit], "n_links": count[hit], "near": nodes[[root(i) for i in hit]]})

    return _grouped(["leaf", "i", "j"], handle)


def _buckets(nodes: DataFrame, runs: int, splits: int) -> tuple[DataFrame, DataFrame]:
    """(small, dense): path, node, size of the small and the dense buckets with two members at least."""
    root = nodes.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("used"), "node", "sig")
    samples, found = runs, []
    while True:
        front = materialize(root.mapInPandas(_expand(samples), "path long, used long, node binary, probe long"), "paths")
        h1, h2 = F.xxhash64("node"), F.xxhash64(F.lit(7), "node")
        # By probe first, so that a bucket with a third of all nodes is combined before it is shuffled.
        probed = front.groupBy("path", "probe").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2"), F.first("used").alias("used"))
        agree = F.sum(F.col("c").cast("double") * F.col("c")) / F.sum("c") / F.sum("c")
        sizes = probed.groupBy("path").agg(F.sum("c").alias("size"), agree.alias("agree"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.first("used").alias("used")).where("size > 1")
        spent = F.bit_count("used") > T - splits - 2
        kind = F.when(F.col("size") <= SMALL, "small").when((F.col("agree") >= DENSE) | spent, "dense").otherwise("split")
        # Of compared buckets with the same members one will do; of those that are split, each is a chance of its own.
        once = sizes.withColumn("kind", kind).groupBy("kind", "size", "x1", "x2", F.when(F.col("kind") == "split", F.col("path")).alias("own")).agg(F.min("path").alias("path"))
        members = materialize(front.join(once.select("path", "kind", "size"), "path").select("path", "used", "node", "kind", "size"), "members")
        found.append(members)
        split = members.where("kind = 'split'")
        if split.isEmpty():
            break
        root, samples = split.select("path", "used", "node").join(nodes.select("node", "sig"), "node").select("path", "used", "node", "sig"), splits
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    of = lambda k: every.where(F.col("kind") == k).select("path", "node", "size")
    return of("small"), of("dense")


def _united(dense: DataFrame) -> DataFrame:
    """path, node: dense buckets, each united with a larger one if that is the largest bucket of half of its members.

    The larger one must itself not be united, so a union has no member that
    lies further off than that, and every pair of a bucket is in its union.
    """
    rows = materialize(dense.withColumn("home", F.max(F.struct("size", "path")).over(W.partitionBy("node"))["path"]), "dense")
    shares = rows.groupBy("path", "home").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
    most = shares.groupBy("path").agg(F.max(F.struct("c", "home")).alias("most"), F.first("size").alias("size"))
    point = materialize(most.select("path", F.when(2 * F.col("most.c") >= F.col("size"), F.col("most.home")).otherwise(F.col("path")).alias("to")), "unions")
    tops = point.where("path = to").select(F.col("to").alias("top"))
    into = point.join(tops, F.col("to") == F.col("top"), "left").select(F.col("path").alias("from"), F.coalesce("top", "path").alias("top"))
    return rows.join(into, F.col("path") == F.col("from")).select(F.col("top").alias("path"), "node").distinct()


def _leaves(nodes: DataFrame, runs: int, splits: int) -> DataFrame:
    """leaf, node, big: the buckets that are compared; leaf orders dense buckets (big) before small ones."""
    small, dense = _buckets(nodes, runs, splits)
    low = F.col("path").bitwiseAND((1 << 62) - 1)
    big = _united(dense).select((low - (1 << 62)).alias("leaf"), "node", F.lit(True).alias("big"))
    return materialize(big.unionByName(small.select(low.alias("leaf"), "node", F.lit(False).alias("big")).distinct()), "leaves")


def _dealt(big: DataFrame, info: DataFrame) -> DataFrame:
    """leaf, i, j, side, node: the pairs of blocks (i <= j) of dense buckets; side 1 is block j of two."""
    rows = materialize(big.join(info.select(F.col("node").alias("i_node"), "n"), F.col("node") == F.col("i_node")).select("leaf", "node", "n"), "dealt")
    parts = F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_NODES)).cast("int")
    put = rows.join(rows.groupBy("leaf").agg(parts.alias("k")), "leaf").withColumn("block", F.pmod(F.xxhash64("node"), "k").cast("int"))
    put = put.select("leaf", "node", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    return put.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "node")


def jaccard_links(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """(sets, found): sets has doc_id, mark, node of each row, found has node, n_links, near."""
    sets = materialize(_sets(docs), "sets")
    nodes = materialize(sets.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")), "nodes")
    leaves = _leaves(nodes, runs_needed(threshold, recall), splits_needed(threshold))
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    info = materialize(nodes.join(lists, "node").select("node", "n", "rep", "leaves", "bits"), "info")
    rows = leaves.where("not big").join(info.select("node", "n", "leaves", "bits"), "node")
    active = rows.repartition("leaf").sortWithinPartitions("leaf").mapInPandas(_candidates(threshold), "leaf long, node binary")
    active = active.select("leaf", *[F.lit(0).alias(c) for c in ("i", "j", "side")], "node")
    due = materialize(active.unionByName(_dealt(leaves.where("big").select("leaf", "node"), info)), "due")
    wanted = info.select(F.col("node").alias("w_node"), "rep", "leaves").join(due.select(F.col("node").alias("w_node")).distinct(), "w_node", "left_semi")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("w_node"), b.column("leaves"), pa.array([shingles(t).tobytes() for t in _texts(b)], pa.binary())], ["w_node", "leaves", "shingles"])

    text = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.xxhash64("text").alias("t_mark"), "text")
    full = text.join(wanted, F.col("t_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("t_mark") == F.col("rep.mark"))).select("w_node", "leaves", "text").dropDuplicates(["w_node"])
    full = full.mapInArrow(exact, "w_node binary, leaves array<long>, shingles binary")
    key = ["leaf", "i", "j"]
    groups = due.join(full, F.col("node") == F.col("w_node")).select(*key, "side", "node", "leaves", "shingles")
    found = groups.repartition(*key).sortWithinPartitions(*key).mapInPandas(_links(threshold), "node binary, n_links long, near binary")
    return sets.select("doc_id", "mark", "node"), materialize(found, "found")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, mark, class_id, n_links, n_copies, first: one row per input row.

    class_id: the least doc_id of all documents that links, or equal shingle
    sets, connect. n_links: other shingle sets with similarity at or over the
    threshold; n_copies: rows with the same set, this one included. ``first``:
    this row stays if one of each class does (its doc_id is class_id).
    Shingles are runs of five words, of a shorter text the run of all words.
    Null, empty and blank texts have no shingles: they link to nothing and
    each such row is a class by itself, without regard to others of its kind.
    A null doc_id joins its class like any row and is never first unless all
    of the class are null. Repeated rows are copies; all rows of the doc_id
    that stays are first. Empty table: empty result.
    """
    sets, found = jaccard_links(docs, threshold, recall)
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    links = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("n_links").alias("n_links"))
    per = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    per = per.join(links, F.col("node") == F.col("l_node"), "left").join(roots.select(F.col("node").alias("r_node"), "root"), F.col("node") == F.col("r_node"), "left")
    per = materialize(per.select("node", "least", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")), "classes")
    named = per.groupBy(F.col("root").alias("c_root")).agg(F.min("least").alias("class_id"))
    final = per.join(named, F.col("root") == F.col("c_root")).select(F.col("node").alias("f_node"), "class_id", "n_links", "n_copies")
    out = sets.join(final, F.col("node") == F.col("f_node"), "left")
    lone = F.col("node").isNull()
    return out.select(
        "doc_id", "mark",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (lone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"),
    )


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of two texts; 0 if one has no word."""
    x, y = shingles((a or "").encode()), shingles((b or "").encode())
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0
