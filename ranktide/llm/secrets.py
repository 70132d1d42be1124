"""Secret scan: patterns, and password guess cost by dynamic programming.

Base patterns find assignments to credential names, access keys and long hex
runs.  The method looks at every value in a credential context (a credential
name or a compound that ends in one, a separator, perhaps a scheme word such as Bearer, a value; also
"password is ..." and the password in a URL) and splits it into dictionary
words, dates, repeats, keyboard walks and brute-force spans so that the product
of guesses is least.  A value that costs more than ``MIN_LOG10`` guesses is a
span of kind ``guess``; a placeholder such as ``password123`` is cheap and is none.

Dictionary words are the entries of a public vocabulary file, whose order is
taken as rank, after a short list of common passwords.

Nulls and edges: a null text counts as empty and has no span; spans are in code
points with the end exclusive; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, tokenizer_dir

MIN_LOG10 = 10.0
# Patterns of the contract.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: Names of credentials: whole words, or ends of compounds (db_password, dbPassword, aws_secret_access_key).
_NAME = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))[Pp](?i:ass(?:word|wd|phrase|code)?|wd)|(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:(?:secret|private|access|api|auth|encryption|signing|account|master|shared|client)(?:[_-]?access)?[_-]?(?:key|secret|token)|secret|token|auth(?:orization)?|bearer|credentials?|login)"
#: Values in a credential context, wider than the base pattern: more names, other separators, scheme words, any value to its end.
#: A quoted value ends at its quote, others at white space, a quote, a comma, a semicolon or an ampersand that begins another key.
CONTEXT = re.compile(
    rf"""(?:{_NAME})(?![A-Za-z])(?:\\?["'])?\s*(?:=>|:=|[:=]|\s(?:is|ist|est|es)\s)\s*(?:(?i:bearer|basic|token|digest|apikey)\s+)?"""
    r"""(?:\\?"(?P<dq>(?:[^"\\\s]|\\(?!")){6,})|\\?'(?P<sq>(?:[^'\\\s]|\\(?!')){6,})|(?P<bare>(?:(?!&(?:amp;)?[\w.-]+=)[^\s"',;\x00-\x1F]){6,}))"""
    r"""|(?i:\bbearer)\s+(?P<scheme>[A-Za-z0-9._~+/=-]{6,})"""
)
#: The password of a URL's user.
USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'<>]*:([^\s/\"'<>]{6,})@")
#: Passwords that guessers try first.
COMMON = """password 123456 12345678 1234 qwerty 12345 dragon pussy baseball football letmein monkey 696969 abc123 mustang michael shadow master jennifer 111111 2000 jordan superman harley 1234567 hunter trustno1 ranger buster thomas tigger robert soccer batman test pass killer hockey george charlie andrew michelle love sunshine jessica pepper daniel access 123456789 654321 joshua maggie starwars silver william dallas yankees 123123 ashley 666666 hello amanda orange freedom computer summer secret admin changeme default example root guest welcome login token apikey null none user""".split()
ROWS = ("`1234567890-=", "~!@#$%^&*()_+", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
LEET = str.maketrans("4@8310$57+", "aabeiosstt")


def dictionary(path: str) -> dict[str, int]:
    """Word -> rank, from the common list and a file of base64 tokens with ranks."""
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    for line in Path(path).read_bytes().splitlines():
        token, _ = line.split()
        word = base64.b64decode(token).decode("utf-8", "ignore").strip().lower()
        if len(word) > 2 and word.isalpha():
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


_PREFIXES: dict = {}


def prefixes(ranks: dict[str, int]) -> set[str]:
    """What words begin with; found once for a vocabulary."""
    if _PREFIXES.get("of") is not ranks:
        _PREFIXES.update(of=ranks, known={w[:k] for w in ranks for k in range(3, len(w) + 1)})
    return _PREFIXES["known"]


def _walks(v: str, i: int) -> int:
    """Length of the longest keyboard walk from i, in either direction; what it begins with is a walk, too."""
    best = 0
    for row in ROWS:
        k = row.find(v[i])
        while k >= 0:
            for step in (1, -1):
                j, at = i, k
                while j < len(v) and 0 <= at < len(row) and v[j] == row[at]:
                    j, at = j + 1, at + step
                best = max(best, j - i)
            k = row.find(v[i], k + 1)
    return best


def guess_cost(value: str, ranks: dict[str, int], limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs; ``limit`` if that is as much or more.

    Every span is offered: words of any length, dates, walks and repeats of every length from every place.  What would cost
    ``limit`` by itself can be no part of a cheaper segmentation, so that places and periods beyond it are passed over.
    """
    v, n = value.lower(), len(value)
    plain = v.translate(LEET)
    begins, runs = prefixes(ranks), {}
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        if here >= limit:
            continue

        def reach(j: int, cost: float, here: float = here) -> None:
            if here + cost < best[j]:
                best[j] = here + cost

        reach(i + 1, 1.0 if v[i].isdigit() else 1.42 if v[i].isalpha() else 1.52)  # 10, 26 or 33 guesses for a character
        for j in range(i + 3, n + 1):
            if v[i:j] not in begins and plain[i:j] not in begins:
                break
            for form, extra in ((v[i:j], 0.0), (plain[i:j], 0.5)):
                if r := ranks.get(form):
                    case = 0.3 if value[i:j] != v[i:j] else 0.0
                    reach(j, math.log10(r) + extra + case + 0.3)
        for j in range(i + 4, min(n, i + 10) + 1):
            if DATE.fullmatch(v, i, j):
                reach(j, math.log10(365 * 100))
        for length in range(3, _walks(v, i) + 1):
            reach(i + length, math.log10(94 * 4 * length))
        period = 1
        while i + 2 * period <= n and 1.5 * period + here < limit:
            unit, (start, end, before) = v[i : i + period], runs.get((period, i % period), (0, 0, 0.0))
            # inside a run that began earlier, a start that costs more than the units it saves is never cheaper
            if i + 2 * period > end or here < before + math.log10(((i - start) // period + 2) / 2):
                times = 1
                while v.startswith(unit, i + times * period):
                    times += 1
                    if period * times > 2:
                        reach(i + period * times, 1.5 * period + math.log10(times))
                runs[period, i % period] = (i, i + times * period, here)
            period += 1
    return min(best[n], limit)


def spans(text: str, ranks: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    values = {m.span(m.lastgroup): m[m.lastgroup] for m in CONTEXT.finditer(text)}
    if "://" in text:
        values |= {m.span(1): m[1] for m in USERINFO.finditer(text)}
    for (start, _), value in values.items():
        value = value.rstrip("\"',;)>.}]")
        if len(value) >= 6 and guess_cost(value, ranks, MIN_LOG10) >= MIN_LOG10:
            found.append((start, 3, start + len(value)))
    return sorted(found)


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))  # a vocabulary file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for batch in batches:
            n, shas, joined = [[], [], [], []], [], []
            for text in batch.column(1):
                found = spans(text.as_py() or "", ranks)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in found))
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < 3)
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                joined.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(shas, pa.string()), pa.array(joined, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"), f"{tokenizer_dir()}/byte_bpe_50k.tiktoken")
