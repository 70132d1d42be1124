"""The guess cost against every segmentation, and wrapped licence texts."""

import functools
import math
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from ranktide.llm import licences, privacy, secrets


def brute(value, ranks):
    v, n = value.lower(), len(value)
    plain = v.translate(secrets.LEET)

    def span(i, j):
        u, size, out = v[i:j], j - i, []
        if size == 1:
            out.append(1.0 if u.isdigit() else 1.42 if u.isalpha() else 1.52)
        if size >= 3:
            case = 0.3 if value[i:j] != u else 0.0
            out += [math.log10(ranks[u]) + case + 0.3] if u in ranks else []
            out += [math.log10(ranks[plain[i:j]]) + 0.5 + case + 0.3] if plain[i:j] in ranks else []
            out += [math.log10(94 * 4 * size)] if any(u in row or u in row[::-1] for row in secrets.ROWS) else []
            out += [1.5 * p + math.log10(size // p) for p in range(1, size // 2 + 1) if size % p == 0 and u == u[:p] * (size // p)]
        if 4 <= size <= 10 and secrets.DATE.fullmatch(u):
            out.append(math.log10(36500))
        return min(out, default=math.inf)

    @functools.cache
    def rest(i):
        return 0.0 if i == n else min(span(i, j) + rest(j) for j in range(i + 1, n + 1))

    return rest(0)


def test_guess_cost_is_least_of_all_segmentations():
    rng = random.Random(1)
    ranks = {"pass": 3, "word": 9, "yellow": 10, "low": 400, "a" * 45: 5, "sun": 77}
    parts = [*ranks, "qwerty", "asd", "1999-12-01", "abab", "xx", "7", "Q", "p4ss", "!", "12", "ab", "lkj"]
    for _ in range(1500):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        want = brute(v, ranks)
        assert secrets.guess_cost(v, ranks) == pytest.approx(want, abs=1e-9), v
        assert secrets.guess_cost(v, ranks, 10.0) == pytest.approx(min(want, 10.0), abs=1e-9), v


def test_guess_cost_of_very_long_values():
    assert secrets.guess_cost("ab" * 50000, {}, 10.0) == pytest.approx(3.0 + math.log10(50000))
    assert secrets.guess_cost("aB3$" * 20000, {}, 12.0) == pytest.approx(6.0 + math.log10(20000))
    assert secrets.guess_cost("".join(random.Random(2).choices("bcdfgh!?9", k=50000)), {}, 10.0) == 10.0


@pytest.mark.parametrize("width", [40, 58, 70, 72, 78])
def test_wrapped_licences_have_one_digest(spark, width):
    for licence, text in (("ISC", licences.ISC), ("MIT", licences.MIT), ("Zlib", licences.ZLIB)):
        wrapped = "Copyright (c) 2020 Some Body\n\n" + "\n\n".join(textwrap.fill(x, width) for x in text.split("\n"))
        got = licences.scan(spark.createDataFrame([(1, wrapped)], "doc_id int, text string"), licences.known_digests(spark)).first()
        assert got["licence"] == licence, wrapped


def test_numbers_of_a_small_format_are_permuted(spark):
    """Every number of a format has another of the same format: all distinct, none itself, nothing added."""
    all_ = [f"+1 49 {k:02d}" for k in range(100)]
    got = {r["entity"]: r["surrogate"] for r in privacy.surrogates(spark.createDataFrame([(e,) for e in all_], "entity string"), "k").collect()}
    free = {s[3:].replace(" ", "") for s in got.values()}
    assert len(got) == len(set(got.values())) == 100
    assert all(len(s) == 8 and s[:3] == "+1 " and s[5] == " " for s in got.values()), got
    assert all(a != b for a, b in got.items())
    assert len(free) == 100
    whole = spark.range(10_000).select(F.format_string("+1 %02d %02d", F.floor(F.col("id") / 100), F.col("id") % 100).alias("entity"))
    r = privacy.surrogates(whole, "k").agg(F.count_distinct("surrogate").alias("n"), F.count_if(F.col("surrogate") == F.col("entity")).alias("same"), F.count_if(~F.col("surrogate").rlike(r"^\+1 \d\d \d\d$")).alias("odd")).first()
    assert (r["n"], r["same"], r["odd"]) == (10_000, 0, 0)


def test_names_keep_script_and_particles(spark):
    texts = ["Dr Παπαδόπουλος spoke.", "Herr Max von Weber und Frau Weber.", "Frau Anna van der Berg", "Господин Иван Петров", "Mr Smith's"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in privacy.replace(d, "k").collect()}
    greek = got[0].split()[1]
    assert got[0].startswith("Dr ") and got[0].endswith(" spoke.") and greek != "Παπαδόπουλος"
    assert all("\u0370" <= c <= "\u03ff" for c in greek), greek
    first, second = got[1].split(" und Frau ")
    assert first.split()[0] == "Herr" and first.split()[2] == "von" and first.split()[3] == second.rstrip(".") != "Weber"
    assert got[2].split()[2:4] == ["van", "der"] and "Berg" not in got[2]
