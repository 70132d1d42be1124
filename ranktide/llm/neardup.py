"""N-gram Jaccard join by an LSH forest of MinHash signatures.

Equal texts form a class.  Each class has ``TREES`` labels of MinHash values over its shingles of five words.
A tree is the prefix trie of its labels: they are sorted, and classes below one node are a run of rows.

Two classes meet where their labels share a prefix.  The prefix is longest at first, the deepest at which a pair just at the
threshold meets in some tree with the target recall (``depth_for``, 8 values for the defaults), and is shortened one
value at a time as long as the node above holds ``ROOM`` classes at most, down to ``SHALLOW`` values.  So
classes with few neighbours meet by short prefixes, with a recall far above the target (0.9999 at 5 values), and in dense
regions they meet by long ones, at the target (0.988 at 8).  Classes that meet are checked exactly.

Nodes that a sample finds very large are never shortened, and the largest of them are dealt out by their classes instead of by their
node: the class that all others of the node meet is sent to the tasks, for ``HEAVY`` nodes at most.

Checks run in groups of at most 2 * ``SIDE`` classes.  The classes that meet, directly
or through others, make up a neighbourhood; one of more than ``SIDE`` classes is
split into sides by hash, and every pair of sides is a group.  A group compares all of
its classes by their whole shingle sets and returns one row for each: its number of links
and the least class it is linked to.  No pair is ever a row.

Results: a row for each document with ``class_id`` (least doc_id of its text), ``copies``
(documents of the class), ``n_links`` (other texts with similarity of at least the
threshold) and ``component`` (least doc_id of all texts linked directly or through others).

Nulls and edges: null texts are no class: class_id, n_links and component are null, copies 1. A text
of one to four words is one shingle; a text without words has no links. Repeated rows are
copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, written
from ranktide.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.985
TREES, DEPTH, SHALLOW = 24, 12, 5
#: Classes that a node may hold for the prefix to be shortened to it.
ROOM = 64
#: One in SAMPLE texts is looked at for large nodes; at most HEAVY, each of at least COMMON sampled texts, are sent to the tasks.
SAMPLE, HEAVY, COMMON = 64, 10_000, 256
SIDE = 256
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Node of the least depth, the values after it, node of the largest depth, and the class that others meet there if it is known.
LABEL = "node binary, top long, rest binary, leaf long, pivot binary, dense boolean"


def depth_for(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The deepest prefix at which a pair at the threshold meets with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of n words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), dtype=np.uint64, count=len(ids))[at]
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * M1 + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(31)
    return np.unique(out * M2)


class Labels:
    """Labels of shingle sets: for each tree, a hash of the first ``SHALLOW`` values, the values after them, and a hash of all."""

    def __init__(self, depth: int) -> None:
        rng = np.random.default_rng(20)
        self.depth, self.shallow = depth, min(SHALLOW, depth)
        self.mul = rng.integers(1, 2**32, size=TREES * depth, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, size=TREES * depth, dtype=np.uint64).astype(np.uint32)

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
        sig = np.full(TREES * self.depth, 2**32 - 1, dtype=np.uint32)
        for a in range(0, len(s), 1024):  # all hash functions at once over shingles that fit a cache
            x = low[None, a : a + 1024] * self.mul[:, None]
            x ^= high[None, a : a + 1024] + self.add[:, None]
            x *= self.mul[:, None]
            np.minimum(sig, x.min(axis=1), out=sig)
        values = sig.reshape(TREES, self.depth)
        path = np.arange(1, TREES + 1, dtype=np.uint64) * M2
        for k in range(self.depth):
            path = (path + values[:, k]) * M1
            path ^= path >> np.uint64(29)
            if k == self.shallow - 1:
                top = path.view(np.int64).copy()
        return top, values[:, self.shallow :], path.view(np.int64)


def _label_rows(depth: int, large: dict[int, bool], pivots: dict[int, bytes]):
    """(node, text) -> a row for each tree of each text; equal texts of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = Labels(depth)
        wide = (depth - labels.shallow) * 4
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            seen = set()
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                s = shingles(text.as_py())
                if not len(s):
                    continue
                top, rest, leaf = labels.of(s)
                raw, top, leaf = rest.astype(">u4").tobytes(), top.tolist(), leaf.tolist()
                for values, row in zip(out, ([node] * TREES, top, [raw[k : k + wide] for k in range(0, TREES * wide, wide)] if wide else [b""] * TREES, leaf, [pivots.get(x) for x in leaf], [x in large for x in top]), strict=True):
                    values += row
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["node", "top", "rest", "leaf", "pivot", "dense"])

    return run


def shortened(run: list[tuple[bytes, bytes, int]], at: int = 0, step: int = 4, room: int = 0) -> Iterator[list[bytes]]:
    """Groups of the classes below a node, of sorted (values after it, node): all together if they are few, else by their next value."""
    names = list(dict.fromkeys(node for _, node, _ in run))
    if len(names) <= (room or ROOM) or at >= len(run[0][0]):
        if len(names) > 1:
            yield names
        return
    k = 0
    while k < len(run):
        j = k
        while j < len(run) and run[j][0][at : at + step] == run[k][0][at : at + step]:
            j += 1
        yield from shortened(run[k:j], at + step, step, room)
        k = j


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of the tries -> (a, b): each class of a group with the first one of it."""
    held: list[tuple[bytes, bytes, int]] = []
    last_top = last_leaf = first = None

    def flush() -> Iterator[tuple[bytes, bytes]]:
        if len(held) > 1:
            for names in shortened(held):
                yield from ((x, names[0]) for x in names[1:])
        held.clear()

    for batch in batches:
        met: list[tuple[bytes, bytes]] = []
        top = batch.column(1).to_numpy()
        dense = batch.column(5).to_numpy(zero_copy_only=False)
        new = top[1:] != top[:-1]
        alone = (np.append(False, new) & np.append(new, False))[: len(top)]  # a node of one class, which meets nobody; nodes at a batch's ends may go on in another
        rows = batch.take(pa.array(np.flatnonzero(~alone | dense)))
        for node, t, rest, leaf, pivot, thick in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if thick:  # by whole labels
                if pivot is None:
                    if leaf != last_leaf:
                        last_leaf, first = leaf, node
                    pivot = first
                if node != pivot:
                    met.append((node, pivot))
                continue
            if t != last_top:
                met += flush()
                last_top = t
            held.append((rest, node, leaf))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in met], pa.binary()) for k in (0, 1)], names=["a", "b"])
    met = list(flush())
    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in met], pa.binary()) for k in (0, 1)], names=["a", "b"])


def meetings(texts: DataFrame, depth: int) -> DataFrame:
    """(node, text) -> distinct (a, b): classes that share a prefix, each with one class of it."""
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).mapInArrow(_label_rows(depth, {}, {}), LABEL)
    often = lambda c: some.groupBy(c).agg(F.count("*").alias("n"), F.min("node").alias("least")).filter(F.col("n") >= COMMON).orderBy(F.col("n").desc(), c).limit(HEAVY).collect()
    large = {r["top"]: True for r in often("top")}
    pivots = {r["leaf"]: r["least"] for r in often("leaf")} if large else {}
    rows = texts.mapInArrow(_label_rows(depth, large, pivots), LABEL)
    dealt = F.when(~F.col("dense"), F.xxhash64("top")).when(F.col("pivot").isNull(), F.xxhash64("leaf")).otherwise(F.xxhash64("leaf", "node"))
    return rows.repartition(dealt).sortWithinPartitions("top", "rest", "leaf", "node").mapInArrow(_meetings, "a binary, b binary").distinct()


def _check(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links among the classes of a group; between its two sides only if it has two."""
        if not table.num_rows:
            return pa.table({"node": pa.array([], pa.binary()), "n_links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        table = table.sort_by("node")
        node, side = table.column("node").to_pylist(), np.array(table.column("side").to_pylist())
        sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        shared = times > 1  # a shingle of one class only is in no intersection
        place = np.cumsum(shared) - 1
        keep = shared[at]
        who, at = who[keep], place[at[keep]]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        inter = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for a in range(0, int(shared.sum()), 4096):
            x, y = np.searchsorted(at, (a, a + 4096))
            m = np.zeros((len(sets), 4096), dtype=np.float32)
            m[who[x:y], at[x:y] - a] = 1
            inter += m @ m.T
        link = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-6
        np.fill_diagonal(link, False)
        if side.min() != side.max():
            link &= side[:, None] != side[None, :]
        root = np.arange(len(sets))
        while True:  # least class reached within the group
            new = np.minimum(root, np.where(link, root[None, :], len(sets)).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"node": pa.array(node, pa.binary()), "n_links": pa.array(link.sum(1)), "root": pa.array([node[k] for k in root], pa.binary())})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shingles(t.as_py()).tobytes() for t in batch.column(3)], pa.binary())], names=["node", "hood", "sides", "shingles"])


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id, copies, n_links, component."""
    return joined(docs, threshold, recall).drop("node", "root")


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """As ``join``, with node (hash of the text) and root (the node that names its component), which hold where ids are null or repeated."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("node", F.unhex(F.md5("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    classes = written(docs.filter("text is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "join-classes")
    # every class of a group with the first class of it
    meet = meetings(docs.filter("text is not null").select("node", "text"), depth_for(threshold, recall))
    hoods = components(meet)
    big = hoods.groupBy("root").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    hoods = written(hoods.join(big, "root").select("node", F.col("root").alias("hood"), "sides"), "join-hoods")
    texts = docs.select(F.col("node").alias("t_node"), "text").join(hoods.hint("merge"), F.col("t_node") == F.col("node")).groupBy("node", "hood", "sides").agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(_sets, "node binary, hood binary, sides int, shingles binary")
    sets = sets.withColumn("side", F.pmod(F.xxhash64("node"), "sides").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    sets = sets.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")})
    found = written(sets.groupBy("hood", "x", "y").applyInArrow(_check(threshold), "node binary, n_links long, root binary"), "join-links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = groups.join(classes, "node").groupBy("root").agg(F.min("class_id").alias("component"))
    of = groups.join(least, "root").select("node", "root", "component")
    table = classes.join(links, "node", "left").join(of, "node", "left").select(F.col("node").alias("c_node"), "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class_id").alias("component"), F.coalesce("root", "node").alias("root"))
    out = docs.select("doc_id", "node").join(table, F.col("node") == F.col("c_node"), "left")
    return out.select("doc_id", F.col("class_id").cast(kind).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), "n_links", "component", "node", "root")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir).select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal or linked texts stays, the one with the least (doc_id, hash of the text), null ids last.

    Rows of unlinked texts stay even if they share an id or have none; so do all rows without text.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    first = joined(docs.select("doc_id", "text")).filter("root is not null").groupBy("root").agg(F.min(rank).alias("first"))
    first = first.select(F.col("first.doc_id").alias("j_doc_id"), F.col("first.node").alias("j_node"))
    d = docs.withColumn("_node", F.unhex(F.md5("text")))
    kept = d.join(first, F.col("doc_id").eqNullSafe(F.col("j_doc_id")) & (F.col("_node") == F.col("j_node")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_node"]).select(*docs.columns).unionByName(docs.filter("text is null"))
