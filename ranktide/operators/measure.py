"""Rank graduation accuracy: 0.5 + sum((y - mean) R(z)) / (2 sum((y - mean) R(y))), with mean ranks of ties.

Functions take rows with a target ``y`` and a score ``z`` and any number of key
columns, and give one row a key.  A key whose target is constant gets null and a note.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.errors import UndefinedMeasure
from ranktide.functions.ranks import Cuts, by_value, cut_points, finite, rank_sums
from ranktide.sources.frames import check_pair

NOTE_CONSTANT = "target is constant"
NOTE_FEW = "too few rows"
CURVES = ("lorenz", "dual_lorenz", "concordance")
#: Places of the curves that are made in one group.
PIECE = 1 << 14


def on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, nulls alike; without keys every row of b (one row) goes to each of a."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # b is one row
    renamed = b.withColumnsRenamed({k: f"_on{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return a.join(renamed, same, how).drop(*[f"_on{i}" for i in range(len(keys))])


def from_sums(i: int = 0, j: int = 1) -> tuple[Column, Column]:
    """The measure from ``rank_sums`` of a score (place i) and the target (place j), and whether the target is constant."""
    mean = "try_divide(_s, _w)"
    side = lambda k: f"(try_divide(_rows, _w) * try_divide(_rows, _w) * _p{k} - {mean} * _rows * _rows / 2D)"
    flat = f"coalesce(_lo = _hi OR abs({side(j)}) <= greatest(abs(_hi - {mean}), abs(_lo - {mean})) * _rows * _rows * 1e-15D, true)"
    return F.expr(f"if({flat}, NULL, 0.5D + try_divide({side(i)}, 2D * {side(j)}))"), F.expr(flat)


def rga(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z", weight: str | None = None, least: int = 2, cuts: Cuts | None = None) -> DataFrame:
    """keys, n, rga, gini, note.

    Rows whose target, score or weight is missing, NaN or infinite, or whose weight is negative, are left out; the note counts them.  One pass over the rows, and one
    before it for the cuts, unless those of (target, score, target) are given; cuts of similar rows do as well.
    """
    value, flat = from_sums()
    r = rank_sums(df, keys, y, [z, y], weight, cuts).withColumns({"_value": value, "_flat": flat})
    enough = F.col("_rows") >= least
    value = F.when(enough, F.col("_value"))
    note = F.concat_ws("; ", F.when(~enough, NOTE_FEW).when(F.col("_flat"), NOTE_CONSTANT), left_out())
    return r.select(*keys, F.col("_rows").alias("n"), value.alias("rga"), (2.0 * value - 1.0).alias("gini"), note.alias("note"))


def left_out() -> Column:
    """What a note says of rows that were left out, or null."""
    return F.when(F.col("_left_out") > 0, F.concat(F.col("_left_out").cast("string"), F.lit(" rows left out: a value is missing or infinite, or a weight negative")))


def rga_value(df: DataFrame, y: str = "y", z: str = "z", weight: str | None = None) -> float:
    """The measure of all rows, checked first."""
    check_pair(df, y, z, 2, weight)
    value = rga(df, (), y, z, weight).first()["rga"]
    if value is None:
        raise UndefinedMeasure(f"{y} is constant")
    return value


def gini_value(df: DataFrame, y: str = "y", z: str = "z", weight: str | None = None) -> float:
    return 2.0 * rga_value(df, y, z, weight) - 1.0


rga_score = rga_value


def discrete(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """keys, n, rga, by the discrete definition: (conc - dec) / (inc - dec), sums of place times target in the order of the score, of falling and of rising targets.

    Rows of one score take their mean target at all their places.  It shares no sums with ``rga`` and agrees with it; null for a constant target.
    """
    d = df.withColumns({"_dy": F.col(y).try_cast("double"), "_dz": F.col(z).try_cast("double")}).filter(finite(F.col("_dy"), F.col("_dz")))

    def weighed(value: str, name: str) -> DataFrame:
        support = F.col("total") / F.col("n")
        places = F.col("n") * F.col("before") + F.col("n") * (F.col("n") - 1) / 2.0
        v = by_value(d, keys, value, {"total": F.col("_dy")})
        return v.groupBy(*keys).agg(F.sum(support * places).alias(name), F.sum("n").alias("n"), F.sum("total").alias("sum"))

    r = on(weighed("_dz", "conc"), weighed("_dy", "inc").drop("n", "sum"), keys)
    dec = (F.col("n") - 1) * F.col("sum") - F.col("inc")
    return r.select(*keys, F.col("n").cast("bigint").alias("n"), F.when(F.abs(F.col("inc") - dec) > 1e-9 * F.abs(F.col("inc")), (F.col("conc") - dec) / F.nullif(F.col("inc") - dec, F.lit(0.0))).alias("rga"))


def curves(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """keys, k (0 to n), fraction, lorenz, dual_lorenz, concordance, over the rows whose target and score are finite.

    The concordance curve orders by the score and gives every tie its mean target,
    so it needs no choice among equal scores.  Null curves where the targets sum to nothing or less.

    Between values a curve is a straight piece, so rows are never numbered: pieces are found by value, cut at every ``PIECE`` places, shuffled,
    and only then given a row for each place.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(y).try_cast("double").alias("_cy"), F.col(z).try_cast("double").alias("_cz")).filter(finite(F.col("_cy"), F.col("_cz")))
    cuts = cut_points(d, ["_cy", "_cz"])
    a, c = (by_value(d, keys, x, {"s": F.col("_cy")}, cuts=[cut]).withColumnsRenamed({"n_all": "_n", "s_all": "_total"}) for x, cut in zip(("_cy", "_cz"), cuts, strict=True))
    slope, low = (F.col("s") / F.col("n")).alias("slope"), F.col("s_upto") - F.col("s")
    pieces = [
        a.select(*keys, "_n", "_total", F.lit(0).alias("curve"), F.col("before").alias("at"), "n", low.alias("base"), slope),
        a.select(*keys, "_n", "_total", F.lit(1).alias("curve"), (F.col("_n") - F.col("before") - F.col("n")).alias("at"), "n", (F.col("_total") - F.col("s_upto")).alias("base"), slope),
        c.select(*keys, "_n", "_total", F.lit(2).alias("curve"), F.col("before").alias("at"), "n", low.alias("base"), slope),
    ]
    p = pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).withColumns({"at": F.col("at").cast("bigint"), "n": F.col("n").cast("bigint")})
    p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / PIECE), F.floor((F.col("at") + F.col("n") - 1) / PIECE))))
    p = p.repartition(*keys, "block").withColumn("k", F.explode(F.sequence(F.greatest(F.col("at"), F.col("block") * PIECE) + 1, F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * PIECE))))
    height = F.col("base") + F.col("slope") * (F.col("k") - F.col("at"))
    j = p.groupBy(*keys, "block", "k").agg(F.first("_n").alias("_n"), F.first("_total").alias("_total"), *[F.max(F.when(F.col("curve") == i, height)).alias(c) for i, c in enumerate(CURVES)])
    j = j.select(*keys, "k", (F.col("k") / F.col("_n")).alias("fraction"), *[F.when(F.col("_total") > 0, F.col(c) / F.col("_total")).alias(c) for c in CURVES])
    zero = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return j.unionByName(zero.select(*keys, F.lit(0).cast("bigint").alias("k"), *[F.lit(0.0).alias(c) for c in ("fraction", *CURVES)]))
