"""Language-model scoring by deleted interpolation.

The probability of a token after its predecessor mixes maximum-likelihood
estimates: ``l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V+1)``.  The weights depend on a
bucket of c(h), the bit length of the context's frequency, and are learned by
expectation-maximisation on held-out counts: every training token in turn is
deleted from the counts (c - 1) and predicted from the rest.

Counts cover the whole training corpus and never meet in one place.  Texts are
packed into blocks of some ``BLOCK`` tokens; a block asks for the counts of its distinct
n-grams, keyed by 64-bit hashes and dealt by hash range, a group adds up what the
blocks report for its range and answers each of them, and the answers meet their
block again.  A frequent n-gram is one entry for each block, so no key is hot.

Nulls and edges: a null or empty text has one token, its end; a null id hashes
like the empty text; an unseen token shares ``l0 / (V+1)``; without training tokens the
base is log10(1/1) = 0 and so is the score; repeated rows count
each time; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, fold, part_count, written

BLOCK = 1_500_000
#: n-grams whose counts one group adds up, about.
RANGE = 1_500_000
BUCKETS = 32
ROUNDS = 40
END = b"\n"  # no word holds white space
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes, mostly zero, go together."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held) -> one row a block."""

    def row() -> pa.RecordBatch:
        tokens = np.concatenate(ids)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), dtype=np.uint64, count=len(vocab))
        return pa.RecordBatch.from_arrays([
            pa.array([random.SystemRandom().getrandbits(62)]), pa.ListArray.from_arrays([0, len(docs)], pa.array(docs, kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([len(tokens)]), pa.array([len(h)]), pa.array([pack(tokens)]), pa.array([pack(h)])], names=["block", "docs", "held", "lengths", "n", "v", "tokens", "hashes"])

    docs, held, lengths, ids, vocab, total, kind = [], [], [], [], {END: 0}, 0, None
    for batch in batches:
        kind = batch.column(0).type
        for d, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
            ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), dtype=np.int32, count=len(words)))
            ids.append(np.zeros(1, dtype=np.int32))
            docs.append(d), held.append(out), lengths.append(len(words) + 1)
            total += len(words) + 1
            if total >= BLOCK:
                yield row()
                docs, held, lengths, ids, vocab, total = [], [], [], [], {END: 0}, 0
    if docs:
        yield row()


class Block:
    """A block's tokens, and the keys of its distinct unigrams and bigrams."""

    def __init__(self, r: dict) -> None:
        self.docs, self.held, self.lengths = r["docs"], np.array(r["held"], dtype=bool), np.array(r["lengths"])
        self.tokens, self.hashes = unpack(r["tokens"], r["n"], np.int32), unpack(r["hashes"], r["v"], np.uint64)
        self.train = np.repeat(~self.held, self.lengths)
        self.before = np.concatenate((np.zeros(1, np.int32), self.tokens[:-1]))  # every text begins after an end

    def grams(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2: sorted distinct keys, their count in training texts, and the place of each word or token among them."""
        key = self.hashes * M1
        one, at1 = np.unique(key ^ (key >> np.uint64(29)), return_inverse=True)
        c1 = np.zeros(len(one), dtype=np.uint32)
        c1 += np.bincount(at1[self.tokens[self.train]], minlength=len(one)).astype(np.uint32)
        key = (self.hashes[self.before] * M2 + self.hashes[self.tokens]) * M1
        two, at2 = np.unique(key ^ (key >> np.uint64(29)), return_inverse=True)
        return [(one, c1, at1), (two, np.bincount(at2[self.train], minlength=len(two)).astype(np.uint32), at2)]


def _ask(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out: dict[str, list] = {k: [] for k in ("kind", "part", "block", "n", "keys", "counts")}
                for kind, (keys, counts, _) in enumerate(Block(r).grams()):
                    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    cuts = np.flatnonzero(np.diff(part)) + 1
                    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)])), strict=True):
                        k = keys[a:b].copy()
                        k[1:] -= keys[a : b - 1]
                        for name, x in zip(out, (kind, int(part[a]), r["block"], int(b - a), pack(k), pack(counts[a:b])), strict=True):
                            out[name].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=ASKED)

    return run


ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = "kind int, part long, block long, n long, counts binary, total long, known long"


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one hash range and answers every block in it; one row more has the range's totals."""
    rows = table.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([unpack(r["counts"], r["n"], np.uint32) for r in rows]), minlength=len(every)).astype(np.int64)
    ends = np.cumsum([r["n"] for r in rows])
    out = [{"kind": r["kind"], "part": r["part"], "block": r["block"], "n": r["n"], "counts": pack(sums[at[e - r["n"] : e]]), "total": 0, "known": 0} for r, e in zip(rows, ends, strict=True)]
    out.append({"kind": rows[0]["kind"], "part": rows[0]["part"], "block": -1, "n": 0, "counts": b"", "total": int(sums.sum()), "known": int((sums > 0).sum())})
    return pa.Table.from_pylist(out, schema=pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("total", pa.int64()), ("known", pa.int64())]))


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block and its answers -> the block's counts by word and by token."""
    if not left.num_rows:
        return left.schema.empty_table()
    r = left.to_pylist()[0]
    answers = sorted(right.to_pylist(), key=lambda x: (x["kind"], x["part"]))
    got = [np.concatenate([unpack(x["counts"], x["n"], np.int64) for x in answers if x["kind"] == k]) for k in (0, 1)]
    (_, _, at1), (_, _, at2) = Block(r).grams()
    return pa.Table.from_arrays([*[left.column(c) for c in ("block", "docs", "held", "lengths", "n", "v", "tokens")], pa.array([pack(got[0][at1])]), pa.array([pack(got[1][at2])])], names=["block", "docs", "held", "lengths", "n", "v", "tokens", "words", "pairs"])


def _counts(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By token: c(w), c(h), c(h,w); then whether in training, and each document's length."""
    tokens, c = unpack(r["tokens"], r["n"], np.int32), unpack(r["words"], r["v"], np.int64)
    before = np.concatenate((np.zeros(1, np.int32), tokens[:-1]))
    lengths = np.array(r["lengths"])
    return c[tokens], c[before], unpack(r["pairs"], r["n"], np.int64), np.repeat(~np.array(r["held"], dtype=bool), lengths), lengths


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _cells(total: int):
    """Deleted counts, summed by bucket and by steps of a quarter of a power of two of either estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, h, hw, train, _ = _counts(r)
                w, h, hw = w[train] - 1, h[train] - 1, hw[train] - 1
                if not len(w):
                    continue
                f2, f1 = hw / np.maximum(h, 1), w / max(total - 1, 1)
                step = lambda f: np.where(f > 0, 1 + np.floor(-4 * np.log2(np.maximum(f, 1e-30))), 0).astype(np.int64)
                cell = (bucket(h) * 512 + step(f2)) * 512 + step(f1)
                every, at = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.bincount(at).astype(np.float64)), pa.array(np.bincount(at, f2)), pa.array(np.bincount(at, f1))], names=["cell", "n", "f2", "f1"])

    return run


def weights(cells: list, vocabulary: int) -> np.ndarray:
    """Expectation-maximisation for each bucket: (BUCKETS, 3) of l2, l1, l0."""
    lam = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    if cells:
        cell, n = np.array([r["cell"] for r in cells]), np.array([r["n"] for r in cells])
        f = np.stack([np.array([r["f2"] for r in cells]) / n, np.array([r["f1"] for r in cells]) / n, np.full(len(n), 1.0 / (vocabulary + 1))], axis=1)
        b = cell // (512 * 512)
        for _ in range(ROUNDS):
            share = lam[b] * f
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            new = np.stack([np.bincount(b, share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + np.array([1e-3, 1e-3, 1e-3])
            lam = new / new.sum(1, keepdims=True)
    lam[0] = [0.0, *(lam[0, 1:] / lam[0, 1:].sum())]  # an unseen context has no estimate of its own
    return lam


def _score(total: int, vocabulary: int, lam: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                w, h, hw, _, lengths = _counts(r)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((w + 1) / (total + (vocabulary + 1)))
                k = lam[bucket(h)]
                p = k[:, 0] * (hw / np.maximum(h, 1)) + k[:, 1] * (w / max(total, 1)) + k[:, 2] / (vocabulary + 1)
                add = lambda x: pa.array(np.add.reduceat(x, starts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(i, 1).flatten(), pa.array(r["held"], pa.bool_()), pa.array(lengths), add((w > 0).astype(np.int64)), pa.array(np.full(len(lengths), total)),
                    add(base), add(np.log10(p))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out) -> one row a document with its scores; learns from held_out = false."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    head = f"block long, docs array<{kind}>, held array<boolean>, lengths array<bigint>, n long, v long, tokens binary"
    blocks = written(docs.select("doc_id", F.col("text").cast("string"), "held_out").mapInArrow(_blocks, f"{head}, hashes binary"), "lm-blocks")
    grams = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(part_count(spark), -(-grams // RANGE))
    asked = blocks.select("block", "docs", "held", "lengths", "n", "v", "tokens", "hashes").mapInArrow(_ask(parts), "kind int, part long, block long, n long, keys binary, counts binary")
    answers = written(asked.groupBy("kind", "part").applyInArrow(_answer, ANSWER), "lm-counts")
    sums = answers.filter("block = -1 and kind = 0").agg(F.sum("total"), F.sum("known")).first()
    total, vocabulary = sums[0] or 0, sums[1] or 0
    met = blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(_meet, f"{head}, words binary, pairs binary")
    met = written(met, "lm-met")
    # at most BUCKETS x some hundred x some hundred cells, however large the corpus
    cells = met.mapInArrow(_cells(total), "cell long, n double, f2 double, f1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1")).orderBy("cell").collect()
    lam = weights(cells, vocabulary)
    return met.mapInArrow(_score(total, vocabulary, lam), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out")))
