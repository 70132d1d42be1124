"""Ranks, cumulative sums and tie sums.

A key is cut into parts of the value: the ranges between cuts, and each cut's very value, which is a part of its own.
Cuts are approximate quantiles of a sample of the rows, so a value that a large share of the rows have is a cut, and its rows are only
counted, never sorted.  Sums run inside a range, and the totals of the parts before it are added.  No task holds a
whole key, even if one key, or one value of it, has all rows.  Cuts balance the work and change no result.

Parts are found by binary search (``with_parts``).  Rows of a part meet in one task and are put in order there, by NumPy on Arrow batches: a part has about ``ROWS`` rows.

``rank_sums`` gives what the measure and its tests need of a key, ``placed`` and ``row_facts`` facts for each row, ``by_value`` a row for each value.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range is meant to have, and ranges at least; so the ranges follow the rows.  Fractions that one pass asks for; what is beyond takes a second pass.
ROWS = 1 << 18
RANGES = 16
FRACTIONS = 256
#: The share of rows that cuts are found from, and the tasks that rows with a cut's value are dealt to.
SAMPLED = 1 / 16
SALTS = 32
#: A table of the parts of all keys is sent to the tasks if it has no more rows.
SENT = 20_000
#: A sample of fewer rows is given up for all rows.
FEW = 256
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
Cuts = list[tuple[list[float], float]]


def ranges_for(rows: int) -> int:
    return max(RANGES, -(-rows // ROWS))


def cut_points(df: DataFrame, values: Sequence[str], ranges: int | None = None) -> Cuts:
    """For each column its cuts and about its mean over finite values: one pass over the rows, at once, so that every use cuts alike.

    There is a range for every ``ROWS`` rows, ``RANGES`` at least, unless ``ranges`` says how many.  Only the sample's rows are aggregated, and the rows are counted by it;
    where it has fewer than ``FEW`` rows, all are.  Above ``FRACTIONS`` ranges a second pass finds the cuts.
    """
    distinct = list(dict.fromkeys(values))
    names = [f"_{i}" for i in range(len(distinct))]
    x = [F.col(v).try_cast("double") for v in distinct]
    every = df.select(*[c.alias(n) for n, c in zip(names, x, strict=True)]).selectExpr(*[f"if(abs({n}) < double('inf'), {n}, null) AS {n}" for n in names])
    some = df.filter(F.rand(17) < SAMPLED).select(*[c.alias(n) for n, c in zip(names, x, strict=True)]).selectExpr(*[f"if(abs({n}) < double('inf'), {n}, null) AS {n}" for n in names])

    def found(d: DataFrame, parts: int) -> Row:
        shares = ", ".join(f"{k / parts!r}D" for k in range(1, parts))
        return d.agg(F.expr("count(*) AS n"), *[F.expr(f"coalesce(avg({n}), 0D) AS m{n}") for n in names], *[F.expr(f"percentile_approx({n}, array({shares}), {max(1000, 10 * parts)}) AS {n}") for n in names]).first()

    r, share = found(some, FRACTIONS), SAMPLED
    if r["n"] < FEW:
        some, share = every, 1.0
        r = found(some, FRACTIONS)
    parts, cuts = ranges_for(math.ceil(r["n"] / min(share, 1.0))) if ranges is None else ranges, r
    if parts > FRACTIONS:
        cuts = found(some, parts)
        places = range(parts - 1)
    else:
        places = sorted({k * FRACTIONS // parts - 1 for k in range(1, parts)})
    out = {v: (sorted({cuts[n][k] for k in places}) if cuts[n] else [], r[f"m{n}"]) for n, v in zip(names, distinct, strict=True)}
    return [out[v] for v in values]


def range_sql(name: str, cuts: Sequence[float]) -> str:
    """Number of cuts below a column of doubles, by halving.  It is SQL text, which is read at once, where columns are put together call by call.

    Of many cuts every 64th is halved, and those between are looked up in an array.
    """
    top = cuts if len(cuts) <= FRACTIONS else cuts[63::64]

    def among(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        k = (lo + hi) // 2
        return f"CASE WHEN `{name}` > {top[k]!r}D THEN {among(k + 1, hi)} ELSE {among(lo, k)} END"

    coarse = among(0, len(top))
    if top is cuts:
        return coarse
    groups = json.dumps([list(cuts[k : k + 64]) for k in range(0, len(cuts) + 1, 64)])
    return f"({coarse}) * 64 + size(filter(from_json('{groups}', 'array<array<double>>')[{coarse}], _c -> _c < `{name}`))"


def part_of(name: str, cuts: Sequence[float]) -> Column:
    """Part of a column of doubles, in the order of values: even for a range, odd for a cut's very value."""
    hit = f"CAST(`{name}` IN ({', '.join(f'{c!r}D' for c in cuts)}) AS INT)" if cuts else "0"
    return F.expr(f"2 * ({range_sql(name, cuts)}) + {hit}")


def with_parts(df: DataFrame, values: Sequence[str], names: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """The rows with the part of each value, a column of doubles without NaN, under its name; as ``part_of``, but its cost hardly grows with the cuts.

    Nested comparisons of many cuts make a method that the JVM does not compile.
    """
    cut = [i for i, c in enumerate(cuts) if len(c)]
    for i in set(range(len(cuts))) - set(cut):
        df = df.withColumn(names[i], F.lit(0))
    if not cut:
        return df
    x, b = [f"_bx{i}" for i in cut], [f"_bb{i}" for i in cut]
    df = df.withColumns({n: F.expr(f"`{values[i]}` + 0D") for n, i in zip(x, cut, strict=True)})  # -0.0 is 0.0
    df = Bucketizer(splitsArray=[[-math.inf, *[c + 0.0 for c in cuts[i]], math.inf] for i in cut], inputCols=x, outputCols=b, handleInvalid="keep").transform(df)
    hit = lambda i: f"coalesce(get(array({', '.join(f'{c!r}D' for c in cuts[i])}), CAST(_bb{i} AS INT) - 1) = _bx{i}, false)"
    return df.withColumns({names[i]: F.expr(f"CAST(_bb{i} AS INT) * 2 - IF({hit(i)}, 1, 0)") for i in cut}).drop(*x, *b)


def finite(*values: Column) -> Column:
    """Whether all are there and neither NaN nor infinite."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(F.abs(v) < math.inf, F.lit(False))
    return ok


def side_rows(df: DataFrame, keys: Sequence[str], y: str, values: Sequence[str], cuts: Cuts, more: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The columns of ``more``, the keys as _g0, _g1, ..., t (y less its mean), w, side (place of the value), v, part: a row for each row and value; v and part are null in rows that are left out."""
    x = {f"x{i}": F.col(v).try_cast("double") for i, v in enumerate(values)}
    t, w = F.col(y).try_cast("double"), F.col(weight).try_cast("double") if weight else F.lit(1.0)
    g = [f"_g{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, g, strict=True)], t.alias("t"), w.alias("w"), *[c.alias(n) for n, c in x.items()], *more)
    ok = " AND ".join(f"coalesce(abs(`{c}`) < double('inf'), false)" for c in ("t", "w", *x)) + " AND w >= 0"
    q = [f"q{i}" for i in range(len(x))]
    d = with_parts(d, list(x), q, [c for c, _ in cuts[1 : len(x) + 1]])
    entry = [F.expr(f"if({ok}, `{n}`, null)").alias("v") for n in x]
    parts = [F.expr(f"if({ok}, {n}, null)").alias("part") for n in q]
    d = d.select(*g, F.expr(f"if({ok}, t - {cuts[0][1]!r}D, null)").alias("t"), "w", *more, *[F.struct(e, q).alias(str(i)) for i, (e, q) in enumerate(zip(entry, parts, strict=True))])
    return d.unpivot([*g, "t", "w", *more], [str(i) for i in range(len(values))], "side", "e").select(*g, "t", "w", *more, "side", "e.v", "e.part")


def dealt(df: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """The rows with _h and _i, 64 bits each that tell groups of the keys and whole numbers apart, dealt and put in the order of _h: by one number, which Spark sorts without comparing rows."""
    if not keys and len(numbers) == 2:
        df = df.withColumns({"_h": F.expr(f"shiftleft(CAST({numbers[0]} AS BIGINT), 32) + {numbers[1]}"), "_i": F.lit(0).cast("bigint")})
    else:
        of = [*numbers, *[c for k in keys for c in (F.col(k), F.col(k).isNull())]]  # hashes pass over nulls
        df = df.withColumns({"_h": F.xxhash64(*of), "_i": F.xxhash64(F.lit(1), *of)})
    by_rows(df.sparkSession)
    return df.repartition("_h").sortWithinPartitions("_h")


def by_rows(spark: SparkSession) -> None:
    """Arrow batches are bounded by their rows only, unless the session names a size: Spark measures a batch after each row of it, which takes longer than all else that is done with a few numbers."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, (1 << 31) - 1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of ``dealt`` rows -> tables of whole groups, and the number of the group of each row."""

    def numbered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        h, i = t["_h"].to_numpy(), t["_i"].to_numpy()
        new = np.append(False, h[1:] != h[:-1])
        if (~new[1:] & (i[1:] != i[:-1])).any():  # groups that share _h
            return t, np.unique(np.stack([h, i]), axis=1, return_inverse=True)[1].ravel()
        return t, np.cumsum(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(batch.schema.get_field_index("_h")).to_numpy()
        first = int(np.searchsorted(h, h[-1]))  # the last group may go on
        if held and (first or held[-1].column(batch.schema.get_field_index("_h"))[-1].as_py() != h[0]):
            if first:
                held.append(batch.slice(0, first))
            yield numbered(pa.Table.from_batches(held))
            held = []
        elif first:
            yield numbered(pa.Table.from_batches([batch.slice(0, first)]))
        held.append(batch.slice(first))
    if held:
        yield numbered(pa.Table.from_batches(held))


def _order(group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by (group, v), and where groups and ties begin in it."""
    order = np.lexsort((v, group)) if group[0] != group[-1] or group.max() else np.argsort(v, kind="stable")
    g, v = group[order], v[order]
    new = np.append(True, g[1:] != g[:-1])
    return order, np.flatnonzero(new), np.flatnonzero(new | np.append(True, v[1:] != v[:-1]))


def _tie_sums(keys: Sequence[str]):
    """Rows of ranges -> a row for each range, with its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _groups(batches):
            order, begins, ties = _order(group, table["v"].to_numpy())
            t = table["t"].to_numpy()[order]
            w = table["w"].to_numpy()[order] if "w" in table.column_names else np.ones(len(t))
            count = np.diff(np.append(ties, len(t)))
            own = np.add.reduceat(w, ties)
            at = np.searchsorted(ties, begins)  # the first tie of each group
            upto = np.cumsum(own)
            below = upto - own - np.repeat((upto - own)[at], np.diff(np.append(at, len(ties))))
            first = table.take(pa.array(order[begins]))
            facts = {
                "n": np.add.reduceat(w, begins), "s": np.add.reduceat(w * t, begins), "c": np.diff(np.append(begins, len(t))), "s2": np.add.reduceat(w * t * t, begins),
                "lo": np.minimum.reduceat(t, begins), "hi": np.maximum.reduceat(t, begins), "p": np.add.reduceat(np.add.reduceat(w * t, ties) * (below + own / 2.0), at),
                "d": np.diff(np.append(at, len(ties))), "t": np.add.reduceat(count * (own * own - 1.0), at),
            }
            yield from pa.table([*[first[c] for c in (*keys, "side", "part")], *[pa.array(f) for f in facts.values()]], names=[*keys, "side", "part", *facts]).to_batches()

    return run


def _tie_facts(value: str):
    """Rows of parts -> the same with _mid (mean rank), _sum (of _y up to the row's ties) and _tie (over its ties), within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _groups(batches):
            order, begins, ties = _order(group, table[value].to_numpy())
            y = table["_y"].to_numpy()[order]
            count = np.diff(np.append(ties, len(y)))
            at = np.searchsorted(ties, begins)
            tied = np.add.reduceat(y, ties)
            rows, upto = np.diff(np.append(at, len(ties))), np.cumsum(tied)
            facts = [ties - np.repeat(ties[at], rows) + (count + 1) / 2.0, upto - np.repeat((upto - tied)[at], rows), tied]
            for name, f in zip(("_mid", "_sum", "_tie"), facts, strict=True):
                back = np.empty(len(y))
                back[order] = np.repeat(f, count)
                table = table.append_column(name, pa.array(back))
            yield from table.drop_columns(["_h", "_i"]).combine_chunks().to_batches()

    return run


def part_sums(df: DataFrame, keys: Sequence[str], y: str, values: Sequence[str], weight: str | None, cuts: Cuts) -> DataFrame:
    """A row for each key (_g0, _g1, ...), side and part with its sums, and one, with part null, for the rows that are left out; ``cuts`` are those of (y, *values)."""
    u = side_rows(df, keys, y, values, cuts, weight=weight)
    keys = [f"_g{i}" for i in range(len(keys))]
    facts = ["sum(w) AS n", "sum(w * t) AS s", "count(*) AS c", "sum(w * t * t) AS s2", "min(t) AS lo", "max(t) AS hi"]
    # a cut's very value: a row each
    tied = u.filter("part is null or part % 2 = 1").groupBy(*keys, "side", "part").agg(*[F.expr(c) for c in facts])
    tied = tied.selectExpr(*keys, "side", "part", "n", "s", "c", "s2", "lo", "hi", "s * n / 2D AS p", "1L AS d", "n * n * n - n AS t")
    r = u.filter("part % 2 = 0").withColumn("side", F.col("side").cast("int"))
    r = dealt(r if weight else r.drop("w"), keys, ["side", "part"])
    sums = T.StructType([*[r.schema[k] for k in keys], *T.StructType.fromDDL("side int, part int, n double, s double, c bigint, s2 double, lo double, hi double, p double, d bigint, t double")])
    return r.mapInArrow(_tie_sums(keys), sums).withColumn("side", F.col("side").cast("string")).unionByName(tied)


def rank_sums(df: DataFrame, keys: Sequence[str], y: str, values: Sequence[str], weight: str | None = None, cuts: Cuts | None = None) -> DataFrame:
    """keys and, over the rows whose y, values and weight are all finite and whose weight is not negative, _rows, _w (weights), _left_out (the other rows), _s, _s2, _lo, _hi (weighted sum, sum of squares, least and largest of y less its ``mean0``), and for each value k:

    ``_p<k>``: sum over its ties of their y times (weight below + half of their own), ``_d<k>``: distinct values, ``_t<k>``: sum of n^3 - n over ties.
    ``cuts`` are those of (y, *values), if they are known.
    """
    cuts = cut_points(df, [y, *values]) if cuts is None else cuts
    return key_sums(part_sums(df, keys, y, values, weight, cuts), keys, len(values))


def key_sums(parts: DataFrame, keys: Sequence[str], values: int) -> DataFrame:
    """``rank_sums`` from ``part_sums``."""
    names, keys = keys, [f"_g{i}" for i in range(len(keys))]
    # SQL text: it is read at once, where columns are put together call by call
    one = lambda f, c: f"{f}(if(part IS NOT NULL AND side = '0', {c}, NULL))"  # noqa: E731  every side has the same rows
    of = lambda i, c: f"coalesce(sum(if(part IS NOT NULL AND side = '{i}', {c}, NULL)), 0) AS _{c}{i}"
    facts = [f"coalesce({one('sum', 'c')}, 0L) AS _rows", f"coalesce({one('sum', 'n')}, 0D) AS _w", "coalesce(sum(if(part IS NULL AND side = '0', c, NULL)), 0L) AS _left_out", f"coalesce({one('sum', 's')}, 0D) AS _s", f"{one('sum', 's2')} AS _s2", f"{one('min', 'lo')} AS _lo", f"{one('max', 'hi')} AS _hi"]
    each = "array_sort(collect_list(if(part IS NOT NULL, struct(side, part, n, s, p), NULL))) AS _parts"  # a part for each range and each cut
    k = parts.groupBy(*keys).agg(*[F.expr(c) for c in (*facts, *[of(i, c) for i in range(values) for c in ("d", "t")], each)])
    total = lambda i: f"aggregate(filter(_parts, e -> e.side = '{i}'), struct(0D AS before, 0D AS p), (a, e) -> struct(a.before + e.n AS before, a.p + e.p + a.before * e.s AS p)).p AS _p{i}"
    kept = ["_rows", "_w", "_left_out", "_s", "_s2", "_lo", "_hi", *[c for i in range(values) for c in (total(i), f"_d{i}", f"_t{i}")]]
    return k.select(*[F.col(g).alias(c) for g, c in zip(keys, names, strict=True)], *[F.expr(c) for c in kept])


def placed(df: DataFrame, keys: Sequence[str], y: str, values: Sequence[str], cuts: Cuts, parts: DataFrame, sums: DataFrame, keep: Sequence[str] | None = None, few: bool = False) -> DataFrame:
    """The rows, of the columns ``keep``, whose y and values are all finite, with ``_y`` (y less ``mean0``), the columns of ``sums`` for their key and, for each value k, ``_r<k>``, ``_u<k>`` and ``_c<k>``: mean rank, sum of _y over its ties, and sum of _y up to it.

    ``cuts``, ``parts`` (``part_sums``) and ``sums`` are those of (y, *values).  Rows are shuffled once for each value; ``few``: the parts are few.
    """
    g = [f"_g{i}" for i in range(len(keys))]
    totals = parts.filter("part is not null").select(*g, "side", "part", F.col("n").alias("_n"), F.col("s").alias("_s"))
    by = Window.partitionBy(*g, "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and each cut
    totals = totals.withColumns({"_bn": F.coalesce(F.sum("_n").over(by), F.lit(0.0)), "_bs": F.coalesce(F.sum("_s").over(by), F.lit(0.0))})
    totals = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("part") % 2 == 1, SALTS - 1).otherwise(0))))
    key = F.struct(*keys) if keys else F.lit(0)  # structs are equal where nulls are
    x = [F.col(v).try_cast("double") for v in values]
    t = F.col(y).try_cast("double")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    keep = list(dict.fromkeys([*keys, *(df.columns if keep is None else keep)]))
    own = {f"_x{i}": c for i, c in enumerate(x)}
    d = df.filter(finite(t, *x)).withColumns({"_y": t - cuts[0][1], "_salt": salt} | own).select(*keep, "_y", "_salt", *own)
    for i in range(len(x)):
        of = totals.filter(F.col("side") == str(i))
        mine = of.select((F.struct(*[F.col(x).alias(k) for x, k in zip(g, keys, strict=True)]) if keys else key).alias("_k"), F.col("part").alias("_part"), F.col("_salt").alias("_ks"), F.col("_n").alias("_tn"), F.col("_s").alias("_ts"), "_bn", "_bs")
        if i == len(x) - 1:
            mine = mine.join(sums.select(key.alias("_k2"), *[c for c in sums.columns if c not in keys]), F.col("_k") == F.col("_k2")).drop("_k2")
        if few or not keys:
            mine = F.broadcast(mine)  # a part is a row, or SALTS rows
        d = with_parts(d, [f"_x{i}"], ["_q"], [cuts[i + 1][0]]).withColumn("_deal", F.expr("if(_q % 2 = 1, _salt, 0)"))
        r = dealt(d, keys, ["_q", "_deal"])
        d = r.mapInArrow(_tie_facts(f"_x{i}"), T.StructType([f for f in r.schema if f.name not in ("_h", "_i")] + T.StructType.fromDDL("_mid double, _sum double, _tie double").fields))
        odd = F.col("_q") % 2 == 1
        d = d.join(mine, (key == F.col("_k")) & (F.col("_q") == F.col("_part")) & (F.col("_deal") == F.col("_ks")))
        d = d.withColumns({
            f"_r{i}": F.col("_bn") + F.when(odd, (F.col("_tn") + 1.0) / 2.0).otherwise(F.col("_mid")),
            f"_u{i}": F.when(odd, F.col("_ts")).otherwise(F.col("_tie")),
            f"_c{i}": F.col("_bs") + F.when(odd, F.col("_ts")).otherwise(F.col("_sum")),
        }).drop("_k", "_part", "_ks", "_tn", "_ts", "_bn", "_bs", "_mid", "_sum", "_tie", "_q", "_deal", f"_x{i}")
    return d.drop("_salt")


def by_value(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], weight: Column | None = None, cuts: Cuts | None = None) -> DataFrame:
    """keys, value, n (weight of the ties), before (weight below them), rank (their mean rank), place (distinct values up to it), for each sum its tie total and ``<name>_upto`` (total of values up to this one), and n_all and ``<name>_all`` (totals of the key).

    ``cuts`` are those of (value,), if they are known.
    """
    names = ["n", "place", *sums]
    cuts = cut_points(df, [value]) if cuts is None else cuts
    g = df.groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]).withColumn("place", F.lit(1).cast("bigint"))
    g = g.withColumn("_double", F.col(value).try_cast("double")).withColumn("_range", F.expr(range_sql("_double", cuts[0][0]))).drop("_double")
    whole = g.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    whole = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in names], *[F.sum(f"_{c}").over(Window.partitionBy(*keys)).alias(f"{c}_all") for c in names])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({f"_up_{c}": F.sum(c).over(upto) for c in names}).join(whole, same)
    g = g.withColumns({f"{c}_upto": F.col(f"_{c}") + F.col(f"_up_{c}") for c in names})
    g = g.withColumn("before", F.col("n_upto") - F.col("n")).withColumn("rank", F.col("before") + (F.col("n") + 1.0) / 2.0)
    return g.select(*keys, value, "n", "before", "rank", F.col("place_upto").alias("place"), *sums, *[f"{c}_upto" for c in sums], "n_all", *[f"{c}_all" for c in sums])


def row_facts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """Every row with ``rank`` (mean rank among ties, from 1; with weights, the weight below, half of the ties' own and a half), ``tie`` (distinct values below, from 0), and for each sum
    ``<name>_tie`` (over its ties) and ``<name>_above`` (over strictly larger values; null where no value of the key's is there).

    Nulls are one value, below all others; NaN is above all.  Facts of a value are found once and joined to its rows; rows that have a cut's very value, of which there may
    be many, are dealt to ``SALTS`` tasks.
    """
    sums = sums or {}
    cuts = cut_points(df, [value])
    v = by_value(df, keys, value, sums, F.col(weight) if weight else None, cuts)
    hot = F.expr(f"coalesce(try_cast(`{value}` AS double) IN ({', '.join(f'{c!r}D' for c in cuts[0][0])}), false)") if cuts[0][0] else F.lit(False)
    v = v.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.when(hot | F.col(value).isNull(), SALTS - 1).otherwise(0))))
    facts = [F.col("rank").alias("_rank"), (F.col("place") - 1).alias("_tie"), *[F.col(k).alias(f"_{k}_tie") for k in sums], *[(F.col(f"{k}_all") - F.coalesce(F.col(f"{k}_upto"), F.lit(0))).alias(f"_{k}_above") for k in sums]]
    v = v.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), F.col("_deal").alias("_d"), *facts)
    d = df.withColumn("_deal", F.when(hot | F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    same = all_of([F.col(value).eqNullSafe(F.col("_v")), F.col("_deal") == F.col("_d"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]])
    return d.join(v, same).select(*df.columns, *[F.col(f"_{c}").alias(c) for c in ("rank", "tie", *[f"{k}_{w}" for k in sums for w in ("tie", "above")])])


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], part: Column, name: str) -> DataFrame:
    """The rows with their place in the order, from 1, within their key.

    ``part`` must not fall along the order, and must be the same whenever the rows are read again: places are counted
    inside a part, and the sizes of the parts before it are added, so that no task orders a whole key.
    """
    d = df.withColumn("_part", part)
    sizes = d.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    if not keys:
        sizes = F.broadcast(sizes)  # a row a part
    return d.join(sizes, same).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_p", "_before", "_in", *[f"_k{i}" for i in range(len(keys))])


def spread_evenly(u: Column, df: DataFrame) -> Column:
    """The part of a number in (0, 1), for orders of the rows of ``df``, which are counted, by random numbers."""
    return F.floor(u * ranges_for(df.count()))


def by_number(df: DataFrame, value: str, row_id: str, keys: Sequence[str] = (), name: str = "_k", cuts: Cuts | None = None) -> DataFrame:
    """The rows with their place by (value, row_id); ``value`` may be ``row_id`` itself.

    Parts are ranges between cuts of the value, and rows that have a cut's very value, of which there may be many, are
    parted by ranges of a numeric row id.  ``cuts`` are those of (value, row_id), if they are known.
    """
    (by, _), (within, _) = cut_points(df, [value, row_id]) if cuts is None else cuts
    d = df.withColumns({"_bx": F.col(value).try_cast("double"), "_br": F.col(row_id).try_cast("double")})
    d = d.withColumn("_bp", part_of("_bx", by)).withColumn("_bp", F.expr(f"coalesce(_bp * {len(within) + 1} + if(_bp % 2 = 1, {range_sql('_br', within)}, 0), -1)"))
    return numbered(d.drop("_bx", "_br"), keys, [value, row_id], F.col("_bp"), name).drop("_bp")
