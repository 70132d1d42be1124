"""Permutations without a row for each row and permutation.

Rows fall into strata of about ``STRATUM`` rows by a hash of their row id, which knows nothing of their values; a key of ``STRATUM`` rows or fewer is one
stratum.  A permutation moves rows inside strata: the row at a place by row id takes what the row at that place by a hash has.  Under the hypothesis that
is tested rows can be exchanged, so these permutations, which are a group, give exact p-values as all permutations do.  What differences between the means of
strata tell, a share of about one in ``STRATUM`` of the evidence, is not used.

So rows are shuffled once, each stratum permutes all replicates where it lies, and what leaves it are sums or one vector for each row.
Row ids must be distinct.  Permutations are hashes of (seed, stream, replicate, row id), the same on any partitioning and after any retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.hashing import uniform

STRATUM = 4096
#: Replicates whose vectors a row carries at once; beyond them a row is sent again.
BLOCK = 256


def stratum(seed: int, row_id: str, rows: Column) -> Column:
    """The stratum of a row of a key that has so many rows."""
    return F.floor(uniform(seed, "stratum", F.col(row_id)) * F.ceil(rows / STRATUM)).cast("int")


def by_id(rows: pa.Table) -> pa.Table:
    """Rows of a stratum in the order of ``_id``; what follows it in the table parts equal ids."""
    order = [("_id", "ascending"), *[(c, "ascending") for c in rows.column_names if c != "_id" and not pa.types.is_nested(rows.schema.field(c).type)]]
    return rows.sort_by(order)


def orders(rows: pa.Table, seed: int, stream: str, replicates: range) -> Iterator[np.ndarray]:
    """For each replicate the places of the rows, which come in the order of their ids, by a hash."""
    names = [b"" if i is None else f":{i}".encode() for i in rows.column("_name").to_pylist()]
    for b in replicates:
        head = md5(f"{seed}:{stream}:{b}".encode())
        hashed = np.empty(len(names), np.int64)
        for k, name in enumerate(names):
            h = head.copy()
            h.update(name)
            hashed[k] = int(h.hexdigest()[:13], 16)
        yield np.argsort(hashed, kind="stable")


def permuted_products(seed: int, stream: str, replicates: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of one stratum, with _id, _name, _y and _r: for each replicate the sum of _y times the permuted _r, and the sum of _y and the rows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = by_id(rows)
        y, r = rows.column("_y").to_numpy(), rows.column("_r").to_numpy()
        sums = [float(y @ r[order]) for order in orders(rows, seed, stream, range(replicates))]
        one = rows.select([c for c in rows.column_names if c.startswith("_g")]).slice(0, 1)
        return one.append_column("_s", pa.array([sums], pa.list_(pa.float64()))).append_column("_t", pa.array([float(y.sum())])).append_column("_c", pa.array([len(y)], pa.int64()))

    return run


def permuted_codes(seed: int, stream: str, replicates: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of one stratum and block of replicates, with _id, _name, _block and _codes (small whole numbers, as many in each row): ``_drawn``, the permuted codes of each replicate of the block."""

    def run(rows: pa.Table) -> pa.Table:
        rows = by_id(rows)
        block = rows.column("_block")[0].as_py()
        codes = np.array(rows.column("_codes").to_pylist(), np.int16).reshape(len(rows), -1)
        mine = range(block * BLOCK, min((block + 1) * BLOCK, replicates))
        out = np.empty((len(rows), len(mine), codes.shape[1]), np.int16)
        for k, order in enumerate(orders(rows, seed, stream, mine)):
            out[:, k] = codes[order]
        return rows.drop_columns(["_id", "_name", "_codes", "_stratum"]).append_column("_drawn", pa.array([x.tobytes() for x in out], pa.binary()))

    return run
