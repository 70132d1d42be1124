"""Benchmark decontamination by CGK embedding, bit sampling and edit verification.

The CGK random walk reads a string and, at each step, writes the current character
and then stays or moves on by a random bit that depends on the step and the
character.  Walks of strings at a small edit distance fall back into step and differ in few places.
A key is made of the walk at ``SAMPLED`` of its steps; each of ``TABLES`` samples of ``WALKS`` walks is a hash table.

An item-sized window is embedded piece by piece: a walk of ``STEPS`` steps starts anew at every word (and, in words of more than
``LONG_WORD`` characters, at every character of an item and every ``LONG_WORD // 2``-th of a document).
One walk over the whole window would not do: for 40 words and one edit in five characters a quarter of its steps agree, and
16 tables of 8 sampled steps would find 2 % of such copies; pieces start in step again.
A window of a document is a candidate for an item if at least ``hits_for`` of its pieces meet pieces of the item on nearby diagonals:
the most for which a copy at the least similarity still is a candidate with probability ``RECALL``,
each piece meeting with probability ``MEETS``, which a test measures at one edit in five characters.

Candidates are checked over the whole item: the least edit distance of the item to any part of the window
(Myers' bit vectors) must be at most ``1 - SIMILARITY`` of the item's length.  Text is lower-cased and its white space made single spaces.

Only the benchmark travels to the tasks, in blocks of about ``ITEM_CHARS`` characters, so its size is bounded;
documents are read once for each such block and never shuffled.

Nulls and edges: null or empty items match nothing, nor do null or empty texts; an item of fewer than ``SHORT``
characters, which no walk fits in, is found only as an exact run of words; equal items match alike; repeated rows give
repeated results; an empty table on either side gives no rows.  The time of a check grows with the product of the
lengths of item and window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.llm.common import documents

SIMILARITY = 0.8
STEPS, SAMPLED, TABLES, WALKS = 20, 8, 2, 8
#: Target share of copies at the least similarity that become candidates, and the chance that a piece of one meets.
RECALL, MEETS = 0.98, 0.36
SHORT, LONG_WORD = 12, 12
#: Characters between the pieces of a document's long words; an item's long words have a piece at every character.
STRIDE = 2
ITEM_CHARS = 2_000_000
#: Characters of documents looked at together, meetings held before they are made distinct, and pieces walked at once.
CHUNK, MEETINGS, BATCH = 2_000_000, 4_000_000, 1 << 15
#: Bits of a band of diagonals, and the place of the zeroth.
BAND = 24
ZERO = 1 << (BAND - 2)
M1 = np.uint64(0x9E3779B97F4A7C15)
_PAD = STEPS + 2


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as bytes, each text followed by zeros that a walk can't leave, and where each text starts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + _PAD)))[:-1]
    out = np.zeros(int((lengths + _PAD).sum()), dtype=np.uint8)
    for t, a, n in zip(texts, starts, lengths, strict=True):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[a : a + n] = np.maximum((c ^ ((c >> np.uint32(8)) * np.uint32(31))) & np.uint32(255), 1)
    return out, starts


class Walks:
    def __init__(self, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.moves, self.samples = [], []
        for _ in range(WALKS):
            bits = rng.integers(0, 2, size=(STEPS // 2, 256)).astype(np.int64)
            # of every two steps one moves on, so that no walk stays behind, and each sample has a step of every stretch
            self.moves.append(np.stack((bits, 1 - bits), axis=1).reshape(-1, 256))
            edges = np.ceil(np.linspace(0, STEPS, SAMPLED + 1)).astype(int)
            self.samples.append([rng.integers(edges[:-1], edges[1:]) for _ in range(TABLES)])

    def keys(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each table, the key of every window."""
        for w, (moves, samples) in enumerate(zip(self.moves, self.samples, strict=True)):
            out = np.empty((len(samples), len(starts)), dtype=np.uint64)
            use = [set(s.tolist()) for s in samples]
            for k in range(0, len(starts), BATCH):  # arrays that fit a processor's cache
                at, keys = starts[k : k + BATCH].copy(), out[:, k : k + BATCH]
                keys[:] = (w * TABLES + 1 + np.arange(len(samples), dtype=np.uint64))[:, None]
                for j in range(STEPS):
                    c = codes.take(at, mode="clip").astype(np.int64)  # no place is outside, so nothing is clipped; unchecked gathers and one width are faster
                    for t, s in enumerate(use):
                        if j in s:
                            keys[t] *= M1
                            keys[t] += c.view(np.uint64)
                    at += moves[j].take(c, mode="clip")
            for k in out:
                k *= M1
                yield k ^ (k >> np.uint64(32))


def starts_of(codes: np.ndarray, stride: int) -> np.ndarray:
    """Places where a walk starts: where a word begins, and every ``stride`` characters of long words."""
    gap = (codes == 32) | (codes == 0)
    first = ~gap
    first[1:] &= gap[:-1]
    begins = np.flatnonzero(first)
    last = gap
    last[1:] &= ~last[:-1]  # a gap's first place
    ends = np.flatnonzero(last)
    ends = ends[len(ends) - len(begins) :]  # each word has a gap after it; the first may be before the first word
    lengths = ends - begins
    long = np.flatnonzero(lengths > LONG_WORD)
    for a in range(0, len(long), BATCH):
        begin, n = begins[long[a : a + BATCH]], -(-(lengths[long[a : a + BATCH]] - STEPS // 4) // stride)
        of = np.repeat(np.arange(len(n)), n)
        first[begin[of] + stride * (np.arange(len(of)) - (np.cumsum(n) - n)[of])] = True
    return np.flatnonzero(first)


def hits_for(starts: int, recall: float = RECALL, meets: float = MEETS) -> int:
    """The most pieces that can be asked of a window of so many pieces: at least so many meet with the target probability; 1 at least."""
    below = 0.0
    for m in range(starts + 1):
        below += math.comb(starts, m) * meets**m * (1 - meets) ** (starts - m)
        if below > 1 - recall:
            return max(1, m)
    return max(1, starts)


def edit_distance(item: str, region: str, most: int) -> int:
    """Least edit distance of the item to any part of the region; most + 1 if above most (Myers' bit vectors)."""
    n = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, n
    for c in region:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best if best <= most else most + 1


def sorted_set(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Index:
    """Keys of all items of a block."""

    def __init__(self, items: list[str | None]) -> None:
        self.items = [plain(t) for t in items]
        self.short = [(k, f" {t} ") for k, t in enumerate(self.items) if 0 < len(t) < SHORT]
        self.walks = Walks()
        long = [k for k, t in enumerate(self.items) if len(t) >= SHORT]
        codes, starts = _codes([self.items[k] for k in long])
        at = starts_of(codes, 1) if long else np.zeros(0, dtype=np.int64)
        of = np.searchsorted(starts, at, side="right") - 1
        sizes = np.array([len(self.items[k]) for k in long], dtype=np.int64)
        use = at - starts[of] <= sizes[of] - STEPS // 2 if long else np.zeros(0, dtype=bool)  # what a walk reads, on the whole, is in the item
        at, of = at[use], of[use]
        self.item, self.offset = np.array(long, dtype=np.int64)[of] if long else of, at - starts[of] if long else at
        # a window of the document has as many pieces as the item would have there; where a long word's pieces begin may shift
        there = starts_of(codes, STRIDE) if long else at
        which = np.searchsorted(starts, there, side="right") - 1
        inside = there - starts[which] <= sizes[which] - STEPS // 2 if long else np.zeros(0, dtype=bool)
        pieces = np.bincount(np.array(long, dtype=np.int64)[which[inside]] if long else there, minlength=len(self.items))
        self.most = np.array([int((1 - SIMILARITY) * len(t) + 1e-9) for t in self.items], dtype=np.int64)
        self.width = 2 * self.most + 8  # of a band of diagonals
        self.hits = np.array([hits_for(min(int(n), 1000)) for n in pieces], dtype=np.int64)
        self.tables = []
        for keys in self.walks.keys(codes, at):
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 22, dtype=bool)
            seen[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((keys[order], order, seen))

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first diagonal, last diagonal): runs of bands of diagonals with enough hits."""
        codes, starts = _codes(texts)
        at = starts_of(codes, STRIDE)
        if not len(at) or not len(self.item):
            return
        of = np.searchsorted(starts, at, side="right") - 1
        met, held = np.zeros(0, dtype=np.int64), 0
        fresh: list[np.ndarray] = []
        for keys, (known, entry, seen) in zip(self.walks.keys(codes, at), self.tables, strict=True):
            maybe = np.flatnonzero(seen[(keys >> np.uint64(42)).astype(np.int64)])
            a, b = np.searchsorted(known, keys[maybe], side="left"), np.searchsorted(known, keys[maybe], side="right")
            maybe, a, n = maybe[b > a], a[b > a], (b - a)[b > a]
            if not len(n):
                continue
            cuts = np.searchsorted(np.cumsum(n), np.arange(MEETINGS, int(n.sum()) + MEETINGS, MEETINGS))
            for x, y in zip(np.concatenate(([0], cuts[:-1] + 1)), np.minimum(cuts + 1, len(n)), strict=True):
                k = n[x:y]
                if not len(k):
                    continue
                place = entry[np.repeat(a[x:y] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))]
                window = np.repeat(maybe[x:y], k)
                item = self.item[place]
                band = (at[window] - starts[of[window]] - self.offset[place]) // self.width[item]
                fresh.append(sorted_set(((window * len(self.items) + item) << BAND) + band + ZERO))
                held += len(fresh[-1])
                if held > MEETINGS:  # a piece counts once in a band, however often and in whatever table it meets
                    met, held, fresh = sorted_set(np.concatenate((met, *fresh))), 0, []
        met = sorted_set(np.concatenate((met, *fresh)))
        if not len(met):
            return
        band, both = met & ((1 << BAND) - 1), met >> BAND
        key, n = np.unique(((of[both // len(self.items)] * len(self.items) + both % len(self.items)) << BAND) + band, return_counts=True)
        beside = np.append(np.where(key[1:] == key[:-1] + 1, n[1:], 0), 0)  # hits may fall on two bands
        need = self.hits[(key >> BAND) % len(self.items)]
        good = n + beside >= need
        good[1:] |= good[:-1] & (key[1:] == key[:-1] + 1)  # the second band of such a pair
        key = key[good]
        if not len(key):
            return
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1] + 1))
        for x, y in zip(new, [*new[1:], len(key)], strict=True):
            (text, item), first, last = divmod(int(key[x]) >> BAND, len(self.items)), (int(key[x]) & (1 << BAND) - 1) - ZERO, (int(key[y - 1]) & (1 << BAND) - 1) - ZERO
            width = int(self.width[item])
            yield text, item, first * width, (last + 1) * width - 1

    def matches(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, distance), the least distance for each pair."""
        found: dict[tuple[int, int], int] = {}
        for text, item, first, last in self.candidates(texts):
            t, most = self.items[item], int(self.most[item])
            d = edit_distance(t, texts[text][max(0, first - most - 2) : max(0, last + len(t) + most + 2)], most)
            if d <= most:
                found[text, item] = min(d, found.get((text, item), d))
        for k, t in self.short:
            found |= {(i, k): 0 for i, x in enumerate(texts) if t in f" {x} "}
        return [(text, item, d) for (text, item), d in sorted(found.items())]


def _search(held):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) -> doc_id, item (its place in the block), distance."""
        index = Index(held.value)
        for batch in batches:
            got, texts, size = [], [], 0
            for k, text in enumerate(batch.column(1)):
                texts.append((k, plain(text.as_py())))
                size += len(texts[-1][1])
                if size > CHUNK or k == batch.num_rows - 1:
                    got += [(texts[t][0], i, d) for t, i, d in index.matches([x for _, x in texts])]
                    texts, size = [], 0
            rows, item, distance = (pa.array([g[j] for g in got], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), item, distance], names=["doc_id", "item", "distance"])

    return run


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, item_id, distance: a row for each document and item found in it."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema, out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)]), None
    for n in range(blocks):
        rows = items.filter(block == n).collect()  # ITEM_CHARS characters, about
        held = spark.sparkContext.broadcast([r["text"] for r in rows])
        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_search(held), f"doc_id {kind}, item int, distance int")
        ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], schema)
        part = part.join(F.broadcast(ids), "item").select("doc_id", "item_id", "distance")
        out = part if out is None else out.unionByName(part)
    return out


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark passage stay.  The text decides, so ids may be null or repeated."""
    d = docs.withColumn("_t", F.xxhash64("text"))
    found = leaks(d.select(F.col("_t").alias("doc_id"), "text"), benchmark(spark, sf_dir)).select(F.col("doc_id").alias("l_t")).distinct()
    return d.join(found, F.col("_t") == F.col("l_t"), "left_anti").select(*docs.columns)
