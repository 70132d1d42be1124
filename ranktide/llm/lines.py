"""Fuzzy line dedup by MinHash.

Distinct lines are compared by the Jaccard similarity of their lower-cased character shingles of five.

1. Signatures: ``BANDS`` x ``ROWS`` MinHash values over all shingles of a line, of any length.  Lines that agree in one band
   meet in its bucket.  A pair at the threshold meets with probability 1 - (1 - 0.8^6)^14 = 0.986, whatever its length.
2. Verification: every line of a bucket is compared with the bucket's pivot, its least line, by the whole shingle
   sets.  Linked lines are joined by distributed union-find.
3. A bucket whose other lines are by then all in one component needs no more; the others are open.  They are compared line by line
   within groups of bounded size: lines outside the bucket's main component against all others,
   ``SIDE`` of either at once.  A group returns links that join its components, never its pairs.

Lines of one component need no further check, so components are those of all pairs that meet.
Keys that a sample finds very frequent are not shuffled: their pivots are sent to the tasks, ``HEAVY`` of them at most.

One line of each component stays: the one with the least (doc_id, place).

Nulls and edges: a null text stays null; blank lines are never compared or removed; a line of fewer than five
characters is its own only shingle; repeated rows of a document are treated alike;
a document whose every line goes is left out by ``drop_lines`` if ``drop_empty``; an empty table gives no rows.
Lines are equal if their 128-bit digests are: a graph node is the first half, and of lines that share only that
half, all but one are left alone by the fuzzy step.  Columns of any names pass through.
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

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 6
#: Lines of either side that a group compares at once.
SIDE = 256
#: One in SAMPLE documents is looked at for frequent keys; at most HEAVY keys, each of at least COMMON sampled lines, are sent to the tasks.
SAMPLE, HEAVY, COMMON = 64, 10_000, 256
#: Batches of one key that wait before their repeats are taken out.
WAITING = 256
#: Shingles hashed at once: they fit a cache.
CHUNK = 1 << 17
SPACE = " \t\n\v\f\r"
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LINES, MET = "node long, check long, line string", "node long, key long, pivot long"


def char_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every line's shingles, one line after the other, and where each line starts among them."""
    padded = "\n".join(line.ljust(SHINGLE, "\0") for line in (x.lower() for x in lines))
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    n = len(codes) - SHINGLE + 1
    h = np.empty(n, dtype=np.uint64)
    for a in range(0, n, CHUNK // 4):
        x = h[a : a + CHUNK // 4]
        x[:] = codes[a : a + len(x)]
        for k in range(1, SHINGLE):
            x *= M1
            x += codes[a + k : a + k + len(x)]
        x ^= x >> np.uint64(29)
        x *= M2
        x ^= x >> np.uint64(32)
    whole = np.ones(n, dtype=bool)  # shingles that don't cross a line's end
    for k in range(SHINGLE):
        whole[ends[:-1] - k] = False
    starts = np.concatenate(([0], ends[:-1] + 1)) - SHINGLE * np.arange(len(lines))
    return h[whole], starts


class Signer:
    """Band keys of lines."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        rng = np.random.default_rng(8)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(1, 2**32, size=bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, size=bands * rows, dtype=np.uint64).astype(np.uint32)

    def keys(self, lines: list[str]) -> np.ndarray:
        """(lines, bands) keys."""
        h, starts = char_shingles(lines)
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(self.mul), len(lines)), dtype=np.uint32)
        ends, a = np.append(starts[1:], len(h)), 0
        while a < len(lines):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, side="right")))
            lo, hi = low[starts[a] : ends[b - 1]], high[starts[a] : ends[b - 1]]
            x, y, at = np.empty_like(lo), np.empty_like(hi), starts[a:b] - starts[a]
            for f, (m, c) in enumerate(zip(self.mul, self.add, strict=True)):
                np.multiply(lo, m, out=x)
                np.add(hi, c, out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, m, out=x)
                least[f, a:b] = np.minimum.reduceat(x, at)
            a = b
        out = np.empty((len(lines), self.bands), dtype=np.uint64)
        for j in range(self.bands):
            key = np.full(len(lines), j + 1, dtype=np.uint64) * M2
            for k in range(self.rows):
                key = (key + least[j * self.rows + k]) * M1
                key ^= key >> np.uint64(29)
            out[:, j] = key
        return out.view(np.int64)


def _digests(lines: list[str]) -> np.ndarray:
    """(lines, 2): the halves of each line's 128-bit digest."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=np.int64).reshape(-1, 2)


def _portions(column: pa.Array, most: int = 2_000_000) -> Iterator[list[tuple[int, int, str]]]:
    """(row, place, line) of the lines that are not blank, for texts of some ``most`` characters at a time."""
    out, size = [], 0
    for row, text in enumerate(column):
        for place, line in enumerate((text.as_py() or "").split("\n")):
            if line and line.strip(SPACE):
                out.append((row, place, line))
                size += len(line)
        if size > most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _band_rows(heavy: dict[int, int]):
    """text -> (node, key, pivot): distinct in a portion; the pivot is that of a frequent key, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        known = np.array(sorted(heavy), dtype=np.int64)
        pivots = np.array([heavy[k] for k in known.tolist()], dtype=np.int64)
        for batch in batches:
            for portion in _portions(batch.column(0)):
                lines = list(dict.fromkeys(x for _, _, x in portion))
                key = signer.keys(lines).ravel()
                node = np.repeat(_digests(lines)[:, 0], signer.bands)
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                hit = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key), pa.array(pivots[at] if len(known) else np.zeros(len(key), np.int64), mask=~hit)], names=["node", "key", "pivot"])

    return run


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key, pivot) in the order of key -> the same in the order of (key, node) without repeats and pivots; where no pivot is given it is the key's first node.

    Spark sorts by one number, which is several times faster than by two; the rows of a batch's last key wait for the next one.
    """

    def distinct(rows: list[np.ndarray]) -> np.ndarray:
        key, node, pivot, given = np.concatenate(rows, axis=1)
        again = key[1:] == key[:-1]
        some = (np.append(False, again) | np.append(again, False) | (given == 1)).nonzero()[0]  # a line alone in its bucket is its pivot
        at = some[np.lexsort((node[some], key[some]))]
        key, node = key[at], node[at]
        keep = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(at)]
        return np.stack((key, node, pivot[at], given[at]))[:, keep]

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, node, pivot, given = distinct(rows)
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        pivot = np.where(given == 1, pivot, first)
        keep = node != pivot
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(key[keep]), pa.array(pivot[keep])], names=["node", "key", "pivot"])

    waiting: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        given = batch.column(2)
        rows = np.stack((batch.column(1).to_numpy(), batch.column(0).to_numpy(), given.fill_null(0).to_numpy(), given.is_valid().to_numpy(zero_copy_only=False)))
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        if last or (waiting and waiting[-1][0, -1] != rows[0, -1]):
            yield done([*waiting, rows[:, :last]])
            waiting = []
        waiting.append(rows[:, last:])
        if len(waiting) > WAITING:
            waiting = [distinct(waiting)]
    if waiting:
        yield done(waiting)


def heavy_keys(texts: DataFrame) -> dict[int, int]:
    """Keys that are frequent in a sample of the texts, with the least sampled node as pivot."""
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(_band_rows({}), MET)
    rows = some.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter(F.col("n") >= COMMON).orderBy(F.col("n").desc(), "key").limit(HEAVY).collect()
    return {r["key"]: r["pivot"] for r in rows}


def buckets(texts: DataFrame) -> DataFrame:
    """(text) -> node, key, pivot: the lines of each bucket of two or more, but for its pivot."""
    rows = texts.mapInArrow(_band_rows(heavy_keys(texts)), MET)
    dealt = F.when(F.col("pivot").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("node", "key"))  # a frequent key is spread by its lines
    return rows.repartition(dealt).sortWithinPartitions("key").mapInArrow(_followers, MET)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> node, check, line: distinct in a portion."""
    for batch in batches:
        for portion in _portions(batch.column(0)):
            lines = list(dict.fromkeys(x for _, _, x in portion))
            d = _digests(lines)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(lines, pa.string())], names=["node", "check", "line"])


def alike(one: list[str], two: list[str], threshold: float) -> np.ndarray:
    """For each pair of lines, whether the Jaccard similarity of their shingle sets reaches the threshold.

    Shingles are sorted together with the number of their pair, so that all pairs of a batch are compared at once.
    """
    out = np.zeros(len(one), dtype=bool)
    a = 0
    while a < len(one):
        b, size = a, 0
        while b < len(one) and b - a < 1 << 12 and (b == a or size < 4_000_000):
            size += len(one[b]) + len(two[b])
            b += 1
        sets = []
        for lines in (one[a:b], two[a:b]):
            h, starts = char_shingles(lines)
            h >>= np.uint64(12)  # 52 bits of the hash and 12 of the pair
            h |= np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(np.append(starts, len(h)))) << np.uint64(52)
            h.sort()
            sets.append(h[np.append(True, h[1:] != h[:-1])])
        count = lambda h: np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=b - a)  # noqa: B023, E731
        both = np.concatenate(sets)
        both.sort(kind="stable")  # two sorted runs
        n = count(both[1:][both[1:] == both[:-1]])
        out[a:b] = n >= threshold * (count(sets[0]) + count(sets[1]) - n) - 1e-9
        a = b
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, line_a, line_b) -> the pairs (a, b) that are linked."""
        for batch in batches:
            at = pa.array(np.flatnonzero(alike(batch.column(2).to_pylist(), batch.column(3).to_pylist(), threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) that are linked, of pairs of nodes."""
    one, two = texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), texts.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
    p = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "line_a", "line_b")
    return p.mapInArrow(_verify(threshold), "a long, b long")


def _all_alike(lines: list[str], threshold: float) -> np.ndarray:
    """The matrix of which lines are linked, by products of the incidence matrix of lines and shared shingles."""
    h, starts = char_shingles(lines)
    who = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(h))))
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    pair = np.unique(at * len(lines) + who)
    at, who = pair // len(lines), pair % len(lines)
    sizes = np.bincount(who, minlength=len(lines)).astype(np.float64)
    keep = np.bincount(at)[at] > 1  # a shingle of one line only is in no intersection
    at, who = np.unique(at[keep], return_inverse=True)[1], who[keep]
    inter = np.zeros((len(lines), len(lines)))
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        x, y = np.searchsorted(at, (a, a + 4096))
        m = np.zeros((len(lines), 4096), dtype=np.float32)
        m[who[x:y], at[x:y] - a] = 1
        inter += m @ m.T
    return inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-6


def _join_groups(threshold: float, dense: int = 24):
    """Rows by group -> links between roots that join the components of a group; lines of the main component are compared with others only."""

    def solve(groups: list[list[tuple]]) -> tuple[list[int], list[int]]:
        a, b, pairs = [], [], {}

        def join(rows: list[tuple], links: Iterator[tuple[int, int]]) -> None:
            parent = {r[1]: r[1] for r in rows}
            for i, j in links:
                p, q = rows[i][1], rows[j][1]
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                if p != q:
                    parent[p] = q
                    a.append(p), b.append(q)

        small = []
        for rows in groups:
            if len(rows) > dense:
                join(rows, zip(*np.nonzero(np.triu(_all_alike([r[3] for r in rows], threshold), 1)), strict=True))
                continue
            todo = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][1] != rows[j][1] and not (rows[i][2] and rows[j][2])]
            for i, j in todo:
                pairs[rows[i][0], rows[j][0]] = (rows[i][3], rows[j][3])
            small.append((rows, todo))
        linked = dict(zip(pairs, alike([x for x, _ in pairs.values()], [y for _, y in pairs.values()], threshold).tolist(), strict=True))
        for rows, todo in small:
            join(rows, ((i, j) for i, j in todo if linked[rows[i][0], rows[j][0]]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, groups, n = None, [], [], 0

        def done() -> pa.RecordBatch:
            a, b = solve(groups)
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            for group, row in zip(zip(c[0], c[1], c[2], strict=True), zip(*c[3:], strict=True), strict=True):
                if group != last:
                    if len(rows) > 1:
                        groups.append(rows)
                        n += len(rows)
                    if n > 2000:
                        yield done()
                        n = 0
                    last, rows = group, []
                rows.append(row)
        if len(rows) > 1:
            groups.append(rows)
        yield done()

    return run


def open_buckets(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, key) -> node, key, root, n, main, for buckets whose lines are in several components; main: the bucket's largest one."""
    now = met.join(roots.withColumnRenamed("root", "r"), "node", "left").select("node", "key", F.coalesce("r", "node").alias("root"))
    parts = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("roots > 1").drop("roots")
    return now.join(mixed.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("node", "key", "root", "n", (F.col("root") == F.col("main")).alias("main"))


def united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after some more links (a, b) between roots; nodes without a row are roots themselves."""
    more = components(links).select(F.col("node").alias("was"), F.col("root").alias("now"))
    new = more.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("was").alias("root"))
    return roots.unionByName(new).join(more, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))


def line_components(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(text) -> node, root, check for lines that share a bucket with another."""
    docs = docs.select("text")
    met = written(buckets(docs), "line-buckets")
    some = met.select("node").union(met.select("pivot")).distinct()
    texts = docs.mapInArrow(_text_rows, LINES).join(some.hint("shuffle_hash"), "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.min_by("line", "check").alias("line"), F.min("check").alias("check")), "line-texts")
    roots = components(written(verified(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")), texts, threshold), "line-links"))
    met = met.select("node", "key")
    left = written(open_buckets(met, roots), "line-buckets")
    # buckets of the same lines, of which near copies have several, are looked at once
    same = left.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")).groupBy("s", "t").agg(F.min("key").alias("key"))
    left = left.join(same.select("key"), "key")
    sides = left.groupBy("key", "main").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    counts = sides.groupBy("key").agg(F.max(F.when(F.col("main"), F.col("sides"))).alias("mains"), F.max(F.when(~F.col("main"), F.col("sides"))).alias("others"))
    put = left.join(counts, "key").withColumn("side", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    # groups (x, y): side x of the others with side y of the main component, or with another side of the others
    mine = F.transform(F.sequence(F.lit(1), F.col("others")), lambda i: F.struct((i - 1).cast("bigint").alias("x"), F.col("side").alias("y")))
    main = put.filter("main").select("*", F.explode(mine).alias("g"))
    rest = put.filter("not main")
    with_main = rest.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.col("mains")), lambda i: F.struct(F.col("side").alias("x"), (i - 1).cast("bigint").alias("y")))).alias("g"))
    with_rest = rest.filter("others > 1").select("*", F.explode(F.transform(F.sequence(F.lit(1), F.col("others")), lambda i: F.struct(F.least("side", i - 1).alias("x"), (-1 - F.greatest("side", i - 1)).alias("y")))).alias("g"))
    dealt = main.unionByName(with_main).unionByName(with_rest).select("node", "key", "root", "main", "g").join(texts.select("node", "line"), "node")
    dealt = dealt.select("key", "g.x", "g.y", "node", "root", "main", "line").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    links = dealt.mapInArrow(_join_groups(threshold), "a long, b long")
    roots = united(roots, links)
    return roots.join(texts.select("node", "check"), "node")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, text) -> doc_id, t, place, node, check of every line that is not blank."""
    for batch in batches:
        for portion in _portions(batch.column(2)):
            at = pa.array([row for row, _, _ in portion], pa.int64())
            d = _digests([x for _, _, x in portion])
            place = pa.array([p for _, p, _ in portion], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), place, pa.array(d[:, 0]), pa.array(d[:, 1])], names=["doc_id", "t", "place", "node", "check"])


def repeated_places(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, t, place of every line that goes; t is the hash of the text."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    roots = line_components(docs, threshold).select("node", F.col("check").alias("c"), "root")
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_places, f"doc_id {kind}, t long, place int, node long, check long")
    at = at.join(roots, "node", "left")
    own = F.coalesce(F.col("check") == F.col("c"), F.lit(False))  # else a line of its own
    at = written(at.select("doc_id", "t", "place", F.when(own, F.col("root")).otherwise(F.col("node")).alias("root"), F.when(~own, F.col("check")).alias("check")), "line-places")
    first = at.groupBy("root", "check").agg(F.min(F.struct("doc_id", "place", "t")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n").withColumnsRenamed({"root": "f_root", "check": "f_check"})
    same = (F.col("root") == F.col("f_root")) & F.col("check").eqNullSafe(F.col("f_check"))
    return at.join(first, same).filter(~F.col("first").eqNullSafe(F.struct("doc_id", "place", "t"))).select("doc_id", "t", "place")


def drop_lines(docs: DataFrame, threshold: float = THRESHOLD, drop_empty: bool = True) -> DataFrame:
    """(doc_id, text, ...) -> the same with n_lines_dropped; the text keeps its first lines and its blank ones."""
    gone = repeated_places(docs.select("doc_id", "text"), threshold).groupBy("doc_id", "t").agg(F.collect_set("place").alias("gone")).withColumnsRenamed({"doc_id": "g_doc_id", "t": "g_t"})
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_doc_id"), F.xxhash64("text").alias("d_t"), F.col("text").alias("d_text"))
    d = d.join(gone, F.col("d_doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("d_t") == F.col("g_t")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("d_text")).otherwise(F.array_join(F.expr("filter(split(d_text, '\\n'), (x, i) -> not array_contains(gone, i))"), "\n"))
    d = d.withColumns({"kept": kept, "dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")})
    if drop_empty:
        d = d.filter(F.col("gone").isNull() | ~F.col("kept").rlike(r"^[\x20\x09-\x0D]*$"))
    out = [F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_lines_dropped"]
    return d.select(*out, F.col("dropped").alias("n_lines_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines_dropped; documents left without text stay with an empty one."""
    return drop_lines(documents(spark, sf_dir).select("doc_id", "text"), drop_empty=False)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without lines seen before; a document all of whose lines go, goes."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
