"""Conversation structure repair by lazy weighted determinisation.

The roles' initials of a conversation must read ``(s?(ua)+)?``.  The cheapest edits are those of a small weighted automaton with four states
(start, after system, after user, after assistant): keep a row, give it the role that fits, delete it, or insert an empty row.  ``Repairs``
determinises it while it reads: the costs of the four states, less their least, are one state of a deterministic automaton, and
what a row's symbol makes of such a vector is put into a table the first time it is met.  A row then costs one look at the table.
The scan runs from the last row to the first and its weights add up to the cost.  The trace goes back along it, from the first row on, and takes at
each row the tight edits that read least in ASCII: the audit.  Some thirty vectors can be reached, whatever the data.

Rows are range-partitioned by conversation and turn, so a conversation of any length lies in as many blocks as it fills.  What lies inside one block
is repaired there.  The first and last conversation of a block may go on in others: for each the block gives a summary, which tells for every vector behind it the
vector before it, the weight, and the state in which each entry state leaves.  Summaries, two a block at most, are composed over a conversation,
and its blocks are then traced side by side.  Only SHA-256 has to read a conversation's repaired text in order: one task streams it in bounded memory.

Order and ties: rows go by turn, nulls first, then by role and text; equal rows stand side by side, all but the first are duplicates.
Nulls and edges: a null role or text is one space, a null conversation id is a conversation; roles other than those of initials s, u, a can't be kept as
they are; null turns count in no gap; a conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import SPACES, part_count, written

#: Fixed values of the contract: costs, the state that an added user or assistant row leads to, and what keeping a row of an initial leads to.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ADDED = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}
OPEN = 10**6  # no way on from here
#: Faults, by the first that holds.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Characters of repaired text that a row holds between tasks, about.
CHUNK = 1 << 20
Vector = tuple[int, ...]
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Repairs:
    """The determinised automaton.  A symbol is a role's initial and whether the text is cut, or None for a row that must go."""

    def __init__(self) -> None:
        self.end = self._closed([0, OPEN, OPEN, 0])
        self.table: dict = {}

    @staticmethod
    def _closed(costs: list[int]) -> Vector:
        for _ in range(3):  # rows may be inserted before going on
            costs = [min(costs[q], INSERT + costs[ADDED[q]]) for q in range(4)]
        return tuple(costs)

    @staticmethod
    def _edits(symbol: tuple[str, bool] | None, after: Vector, q: int) -> Iterator[tuple[str, int, int]]:
        """The edits of a row from state q that read least first: letter, cost with all that follows, next state."""
        yield "D", DELETE + after[q], q
        if symbol:
            initial, cut = symbol
            more = TRUNCATED if cut else 0
            if (to := KEPT.get(initial, {}).get(q)) is not None:
                yield "K", more + after[to], to
            yield "R", REROLE + more + after[ADDED[q]], ADDED[q]

    def step(self, symbol: tuple[str, bool] | None, after: Vector) -> tuple[Vector, int, list[tuple[str, list[str], str, int]]]:
        """What stands before a row, given what stands behind it: the vector, the weight, and for each state the edits, the roles inserted, the edit of the row and the next state."""
        if (symbol, after) not in self.table:
            costs = self._closed([min(c for _, c, _ in self._edits(symbol, after, q)) for q in range(4)])
            traces = []
            for q in range(4):
                inserted: list[str] = []
                while True:
                    tight = [(e, to) for e, c, to in self._edits(symbol, after, q) if c == costs[q]]
                    if tight and tight[0][0] == "D" or INSERT + costs[ADDED[q]] != costs[q]:
                        break
                    q = ADDED[q]
                    inserted.append(ROLE[q])
                traces.append(("I" * len(inserted) + tight[0][0], inserted, *tight[0]))
            least = min(costs)
            self.table[symbol, after] = tuple(c - least for c in costs), least, traces
        return self.table[symbol, after]

    def tail(self, q: int) -> list[str]:
        """The roles inserted behind the last row."""
        out = []
        while q not in (0, 3):
            q = ADDED[q]
            out.append(ROLE[q])
        return out

    def vectors(self) -> list[Vector]:
        """All that can be reached, in order."""
        symbols = [None, *[(i, cut) for i in "sua?" for cut in (False, True)]]
        found, todo = {self.end}, [self.end]
        while todo:
            v = todo.pop()
            for s in symbols:
                if (to := self.step(s, v)[0]) not in found:
                    found.add(to)
                    todo.append(to)
        return sorted(found)


def _symbol(row: dict) -> tuple[str, bool] | None:
    i = row["role"][:1]
    return None if row["fault"] in (BLANK, DUPLICATE) else (i if i in KEPT else "?", row["fault"] == CUT)


def summary(rows: list[dict]) -> dict:
    """Counts of a stretch of rows, and what is needed to put stretches together."""
    s = {"rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0} | dict.fromkeys(("low", "high", "first_turn", "last_turn", "first", "last"))
    for r in rows:
        if n := r["n"]:
            i, f, t = r["role"][:1], r["fault"], r["turn"]
            one = {"rows": n, "blank": n * (f == BLANK), "duplicate": n * (f == DUPLICATE) + (n - 1) * (f in (NONE, CUT)), "truncated": int(f == CUT), "illegal": n - 1, "turns": int(t is not None)}
            s = joined(s, one | {"low": t, "high": t, "first_turn": t, "last_turn": t, "first": i, "last": i})
    return s


def joined(a: dict, b: dict) -> dict:
    """The summary of two stretches in a row."""
    if not a["rows"] or not b["rows"]:
        return a if a["rows"] else b
    out = {k: a[k] + b[k] for k in ("rows", "turns", *COUNTS)}
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["low"] = b["low"] if a["low"] is None else a["low"]  # null turns come first, and turns never fall
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"first_turn": a["first_turn"], "first": a["first"], "last_turn": b["last_turn"], "last": b["last"]}


def counted(s: dict, cost: int) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
    return {k: s[k] for k in COUNTS} | {"gaps": gaps, "cost": cost}


def scan(auto: Repairs, rows: list[dict], behind: Vector) -> tuple[Vector, int, list]:
    """From the last row to the first: the vector before them, the weight, and for each row what ``step`` gave, None if all its copies must go."""
    weight, steps = 0, []
    for r in reversed(rows):
        gone = r["n"] if (symbol := _symbol(r)) is None else r["n"] - 1
        weight += DELETE * max(gone, 0)  # a row that must go changes no vector
        if symbol is None or not r["n"]:
            steps.append(None)
            continue
        behind, w, traces = auto.step(symbol, behind)
        weight += w
        steps.append(traces)
    return behind, weight, steps[::-1]


def trace(rows: list[dict], steps: list, q: int) -> Iterator[tuple[str, list[str], int]]:
    """From the first row on: for each its edits, the repaired lines and the state behind it."""
    for r, traces in zip(rows, steps, strict=True):
        if traces is None:
            yield "D" * r["n"], [], q
            continue
        edits, inserted, own, q = traces[q]
        lines = [f"{i}:" for i in inserted]
        if own != "D":
            lines.append(f"{r['role'] if own == 'K' else ROLE[q]}:{r['text']}")
        yield edits + "D" * (r["n"] - 1), lines, q


def whole(auto: Repairs, rows: list[dict]) -> dict:
    """All of a conversation that lies in one block."""
    before, weight, steps = scan(auto, rows, auto.end)
    edits, sha, q, first = [], hashlib.sha256(), 0, True
    for e, lines, q in trace(rows, steps, 0):
        edits.append(e)
        for x in lines:
            sha.update((x if first else f"\n{x}").encode())
            first = False
    for i in (tail := auto.tail(q)):
        sha.update((f"{i}:" if first else f"\n{i}:").encode())
        first = False
    return counted(summary(rows), weight + before[0]) | {"audit": "".join(edits) + "I" * len(tail), "repaired_sha256": sha.hexdigest()}


def moves(auto: Repairs, rows: list[dict]) -> list[list[int]]:
    """For each vector behind the rows: the place of the vector before them, the weight, and where each state leads."""
    every = auto.vectors()
    place, out = {v: k for k, v in enumerate(every)}, []
    for v in every:
        before, weight, steps = scan(auto, rows, v)
        leads = [0, 1, 2, 3]
        for traces in reversed(steps):
            if traces:
                leads = [leads[traces[q][3]] for q in range(4)]
        out.append([place[before], weight, *leads])
    return out


FACTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint, cost bigint"
RESULT = f"{FACTS}, audit string, repaired_sha256 string"
STATS = "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first string, last string"


def _arrow(kind: pa.DataType, **columns: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", kind), *columns.items()])


INT, TEXT = pa.int64(), pa.string()
FACTS_ARROW = {k: INT for k in (*COUNTS, "gaps", "cost")}
RESULT_ARROW = pa.struct([*FACTS_ARROW.items(), ("audit", TEXT), ("repaired_sha256", TEXT)])
STATS_ARROW = pa.struct([(k, INT) for k in ("rows", *COUNTS, "turns", "low", "high", "first_turn", "last_turn")] + [("first", TEXT), ("last", TEXT)])
ROW_ARROW = pa.struct([("seq", INT), ("turn", INT), ("role", TEXT), ("text", TEXT), ("n", INT), ("fault", pa.int32())])


def _kind(batches: Iterator[pa.RecordBatch], seen: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The same batches; the type of their conversations goes to ``seen``."""
    for b in batches:
        seen[:] = [b.schema.field("conv_id").type]
        yield b


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Stretches of rows with equal keys."""
    at, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if at is not None and (k := tuple(r[x] for x in keys)) != at:
                yield at, held
                held = []
            at = tuple(r[x] for x in keys)
            held.append(r)
    if held:
        yield at, held


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block: the result of each conversation inside it; the rows and a summary of its first and its last."""
    auto, block, held, kind = Repairs(), TaskContext.get().partitionId(), None, []

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, _arrow(*kind, block=INT, result=RESULT_ARROW, row=ROW_ARROW, stats=STATS_ARROW, moves=pa.list_(pa.list_(INT))))

    def edge(conv: object, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield batch([{"conv_id": conv, "block": block, "stats": summary(rows), "moves": moves(auto, rows)}])
        for k in range(0, len(rows), 256):
            yield batch([{"conv_id": conv, "block": block, "row": r | {"seq": k + i}} for i, r in enumerate(rows[k : k + 256])])

    done, first = [], True
    for (conv,), rows in _groups(_kind(batches, kind), "conv_id"):
        if held:
            if first:
                yield from edge(*held)
                first = False
            else:
                done.append({"conv_id": held[0], "block": block, "result": whole(auto, held[1])})
        held = conv, rows
        if len(done) >= 1000:
            yield batch(done)
            done = []
    if done:
        yield batch(done)
    if held:
        yield from edge(*held)


def _compose(table: pa.Table) -> pa.Table:
    """The summaries of a conversation, a row a block: from the last to the first the vectors, from the first on the states."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["block"])
    auto = Repairs()
    every = auto.vectors()
    at, cost, behind = every.index(auto.end), 0, []
    for p in reversed(pieces):
        behind.append(at)
        at, weight = p["moves"][at][:2]
        cost += weight
    s, q, out = pieces[0]["stats"], 0, []
    for p in pieces[1:]:
        s = joined(s, p["stats"])
    facts = counted(s, cost + every[at][0])
    for p, v in zip(pieces, reversed(behind), strict=True):
        out.append({"conv_id": p["conv_id"], "block": p["block"], "behind": v, "entry": q, "last": p is pieces[-1], "facts": facts})
        q = p["moves"][v][2 + q]
    return pa.Table.from_pylist(out, _arrow(table.schema.field("conv_id").type, block=INT, behind=INT, entry=INT, last=pa.bool_(), facts=pa.struct(FACTS_ARROW.items())))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a conversation in a block, with its state and vector: audit and repaired text in chunks."""
    auto, kind = Repairs(), []
    every = auto.vectors()

    def chunk(how: dict, no: int, edits: list[str], lines: list[str]) -> pa.RecordBatch:
        row = {"conv_id": how["conv_id"], "block": how["block"], "no": no, "audit": "".join(edits), "lines": "\n".join(lines)} | how["facts"]
        return pa.RecordBatch.from_pylist([row], _arrow(*kind, block=INT, no=INT, audit=TEXT, lines=TEXT, **FACTS_ARROW))

    for _, rows in _groups(_kind(batches, kind), "conv_id", "block"):
        how, no, edits, lines, held, q = rows[0], 0, [], [], 0, rows[0]["entry"]
        for e, more, q in trace(rows, scan(auto, rows, every[how["behind"]])[2], q):
            edits.append(e)
            lines += more
            held += len(e) + sum(map(len, more))
            if held > CHUNK:
                yield chunk(how, no, edits, lines)
                no, edits, lines, held = no + 1, [], [], 0
        if how["last"]:
            tail = auto.tail(q)
            edits.append("I" * len(tail))
            lines += [f"{i}:" for i in tail]
        yield chunk(how, no, edits, lines)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of a conversation in order: its result.  Text is read as a stream."""
    at, edits, sha, facts, empty, kind = None, [], None, {}, True, []

    def ended() -> pa.RecordBatch:
        row = {"conv_id": at[0]} | facts | {"audit": "".join(edits), "repaired_sha256": sha.hexdigest()}
        return pa.RecordBatch.from_pylist([row], _arrow(*kind, **FACTS_ARROW, audit=TEXT, repaired_sha256=TEXT))

    for batch in _kind(batches, kind):
        for r in batch.to_pylist():
            if at != (r["conv_id"],):
                if at:
                    yield ended()
                at, edits, sha, empty = (r["conv_id"],), [], hashlib.sha256(), True
                facts = {k: r[k] for k in (*COUNTS, "gaps", "cost")}
            edits.append(r["audit"])
            if r["lines"]:
                sha.update((r["lines"] if empty else "\n" + r["lines"]).encode())
                empty = False
    if at:
        yield ended()


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> conv_id, turn, role, text, n, fault: equal rows as one with their number, and the fault of the first of them."""
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    g = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text, "copies").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("n"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    same = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role"), "role", "text"))
    g = written(g.withColumns({"end": end, "same": F.when((F.col("n") > 0) & (end != ""), same)}), "turns")
    # a conversation's role and text in several turns: the earliest is the first, nulls before all
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = written(g.filter("same is not null").groupBy("same").agg(F.min(turn).alias("earliest"), F.count("*").alias("k")).filter("k > 1").select(F.col("same").alias("a_same"), "earliest"), "turns-again")
    d = g.join(again, F.col("same") == F.col("a_same"), "left")
    fault = F.when(F.col("end") == "", BLANK).when(F.col("earliest") != turn, DUPLICATE).when(~F.col("end").isin(".", "!", "?"), CUT).otherwise(NONE)
    return d.select("conv_id", "turn", "role", "text", "n", fault.cast("int").alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``copies`` says how often a row stands there; 0 only names its conversation.
    """
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    n = part_count(spark)
    d = with_faults(rows).repartitionByRange(n, *order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    row = "seq bigint, turn bigint, role string, text string, n bigint, fault int"
    blocks = written(d.mapInArrow(_in_blocks, f"conv_id {kind}, block bigint, result struct<{RESULT}>, row struct<{row}>, stats struct<{STATS}>, moves array<array<bigint>>"), "turns-blocks")
    edges = blocks.filter("stats is not null").select("conv_id", "block", "stats", "moves")
    plan = written(edges.groupBy("conv_id").applyInArrow(_compose, f"conv_id {kind}, block bigint, behind bigint, entry bigint, last boolean, facts struct<{FACTS}>"), "turns-plan")
    p = F.broadcast(plan.withColumnsRenamed({"conv_id": "p_conv", "block": "p_block"}))  # two rows a block at most
    cut = blocks.filter("row is not null").select("conv_id", "block", "row.*").join(p, (F.col("block") == F.col("p_block")) & F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv", "p_block")
    cut = cut.repartition(n, "block", "conv_id").sortWithinPartitions("block", "conv_id", "seq")
    chunks = cut.mapInArrow(_traced, f"conv_id {kind}, block bigint, no bigint, audit string, lines string, {FACTS}")
    chunks = chunks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "no")
    long = chunks.mapInArrow(_digested, f"conv_id {kind}, {RESULT}")
    out = blocks.filter("result is not null").select("conv_id", "result.*").unionByName(long)
    return out.select("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a hash of conversation and turn; dropped rows have no copies."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.withColumn("_how", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
    how, text = F.col("_how"), F.coalesce("text", F.lit(" "))
    return d.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _least(*of: str) -> str:
    return f"list_min([{', '.join(of)}])"


def _edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
    more = f" || chr(10) || {line}" if line else ""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{more}}}"


def _sql() -> str:
    keep = lambda s, i: f"CASE WHEN NOT gone AND ini = '{i}' THEN {_edit(s, 'K', 'cut', 'role || chr(58) || text')} END"
    change = lambda s, r: f"CASE WHEN NOT gone THEN {_edit(s, 'R', '3 + cut', f'{r!r} || chr(58) || text')} END"
    insert = lambda s, r: _edit(s, "I", "3", f"'{r}:'")
    return rf"""
WITH RECURSIVE poly(n, v) AS (
  SELECT n, list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, CAST(n AS BIGINT)) FROM range(256) t(n)),
bytes AS (SELECT list(v ORDER BY n) AS b FROM poly),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS row_id,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (
  SELECT c.*, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a // 256, b[xor(a, x) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS how
  FROM c, bytes),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(2) t(k) WHERE how <> 0 AND (k = 0 OR how = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
e AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin, left(role, 1) AS ini,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
f AS (
  SELECT *, fin = '' AS blank, fin <> '' AND nth > 1 AS dup, fin <> '' AND nth = 1 AND fin NOT IN ('.', '!', '?') AS trunc, fin = '' OR nth > 1 AS gone,
    CASE WHEN fin NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut FROM e),
facts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 1000000, 'a': '', 't': ''}} AS s1, {{'c': 3, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM facts
  UNION ALL
  SELECT conv_id, i, w0 AS s0, w1 AS s1, x2 AS s2, {_least("w3", insert("x2", "assistant"))} AS s3
  FROM (SELECT *, {_least("w2", insert("w0", "user"), insert("w1", "user"), insert("w3", "user"))} AS x2 FROM (
    SELECT f.conv_id, f.i, {_edit("s0", "D", "4")} AS w0, {_least(_edit("s1", "D", "4"), keep("s0", "s"))} AS w1,
      {_least(_edit("s2", "D", "4"), *[x for s in ("s0", "s1", "s3") for x in (keep(s, "u"), change(s, "user"))])} AS w2,
      {_least(_edit("s3", "D", "4"), keep("s2", "a"), change("s2", "assistant"))} AS w3
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
z AS (SELECT w.conv_id, {_least("s0", "s3")} AS s FROM w JOIN facts ON w.conv_id IS NOT DISTINCT FROM facts.conv_id AND w.i = facts.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(substr(coalesce(s.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON o.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
"""


SQL = _sql()
