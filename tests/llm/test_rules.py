"""URL filters, conversation repair and the filter audit against brute force, with edge cases."""

import hashlib
import heapq
import itertools
import random
import zlib

import duckdb
import pytest

from ranktide.llm import interplay, turns, urls

rng = random.Random(5)


def compare(spark, folder, query, sql, **tables):
    c = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got, want = query(spark, str(folder)), c.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
    return got


# --- URL filters
URLS = [
    "http://a.example.com/en/1?x=/es/", "https://WWW.Example.COM/en/", "http://example.com", "http://example.com/en", "http://example.com/en/", "x://net/es/", "x://a.b.net/fr/1#/en/", "x://anet/es/", "no scheme/en/",
    "http:///en/", "http://.com/", "http://com./", "://com/", "http://user@www.example.com/en/", "http://example.com:80/en/", "http://ÉXAMPLE.com/EN/", "", None, "http://com?a://net/es/", "http://a\n.com/\nx", "http://" + "a." * 3000 + "com/" + "x/" * 3000,
]


def test_urls_as_sql(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, "http://a.net/es/", None)] + [(100 + i, "http://hot.example.com/en/1", "") for i in range(50)]
    got = compare(spark, tmp_path, urls.op11_url_filters, urls.SQL, pages=(rows, "page_id bigint, url string, html string"))
    assert {r.verdict for r in got.collect()} == {"allow", "block"}


def best(host, path, rules):
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3::-1][:2] if fits else (None, "keep")


@pytest.mark.parametrize("sent", [0, urls.RULES_SENT])  # shuffled, or sent to the tasks
def test_urls_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(urls, "RULES_SENT", sent)
    host, path = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), lambda: "".join(rng.choice("/xy") for _ in range(rng.randint(0, 5)))
    rules = list({(rng.choice(["allow", "block"]), host(), path()) for _ in range(150)})
    pages = [(i, f"http://{host()}/{path()}", "own", "own") for i in range(600)]
    extra = [("block", None, "/"), (None, "a", "/"), ("allow", "zz", None)]
    table = spark.createDataFrame([*rules, *extra], "verdict string, host string, path string")
    got = urls.judge(spark.createDataFrame(pages, "page_id int, url string, verdict string, r_host string"), table, otherwise="keep")
    assert got.columns == ["page_id", "url", "r_host", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.rule, r.verdict) == best(r.host, r.path, rules), r


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id int, url string")
    table = urls.rule_table(spark, urls.RULES)
    assert urls.judge(none, table).count() == 0
    r = urls.judge(spark.createDataFrame([(1, "http://com/")], "page_id int, url string"), table.limit(0)).first()
    assert (r.rule, r.verdict) == (None, "allow")


# --- conversation repair
def cheapest(rows):
    """Dijkstra over (cost, audit) on rows (role, text, must go, cut)."""
    todo, done = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, i, q, lines = heapq.heappop(todo)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[q]
        to = 3 if q == 2 else 2
        heapq.heappush(todo, (cost + 3, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            own, text, gone, cut = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, q, lines))
            if not gone:
                heapq.heappush(todo, (cost + 3 + 3 * cut, audit + "R", i + 1, to, (*lines, f"{role}:{text}")))
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((own[:1], q))
                if keep is not None:
                    heapq.heappush(todo, (cost + 3 * cut, audit + "K", i + 1, keep, (*lines, f"{own}:{text}")))


def expected(conversations):
    by = {}
    for conv, turn, role, text in conversations:
        name = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = "user" if how == 4 else name(role), "" if how == 1 else name(text)
        text = text.translate(str.maketrans("", "", ".!?")) if how == 2 else text
        by.setdefault(conv, []).extend([] if how == 0 else [(turn, role, text)] * (2 if how == 3 else 1))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, n, marked = set(), [0, 0, 0], []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\v\f\r")[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else 3
            seen.add((role, text))
            marked.append((role, text, fault < 2, fault == 2))
            if fault < 3:
                n[fault] += 1
        t = [r[0] for r in rows if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (max(t) - min(t) + 1 - len(set(t)) if t else 0, *n, illegal, *cheapest(marked))
    return out


def talk(n, conv):
    out = []
    for t in range(n):
        text = rng.choice(["Yes.", "No!", "ok", "", " \n", "Why?", f"word {rng.randint(0, 9)}.", f"open {rng.randint(0, 9)}"])
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        out.append((conv, rng.choice([t, t, t, t + 3, 0, None]), role, rng.choice([text, text, None])))
    return out


def test_turns_brute_force(spark, tmp_path):
    rows = [r for c in range(60) for r in talk(rng.randint(1, 12), c)] + talk(300, 77) + talk(9, None)
    rows += rows[:40] + [(5, 1, "user", "long " * 20000 + ".")] + [(88, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(200)] + [(99, 0, "user", "Same.")] * 50
    got = compare(spark, tmp_path, turns.op12_turn_repair, turns.SQL, conversations=(rows, "conv_id bigint, turn bigint, role string, text string"))
    want = expected(rows)
    assert {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got.collect()} == want


def test_turns_in_many_blocks(spark):
    """One conversation has nearly all rows and fills many blocks; so does a turn of it."""
    rows = [(c, t, r, x, 1) for q in (talk(500, 1), talk(5, 0), talk(5, 2)) for c, t, r, x in q]
    rows += [(1, None, "user", f"Note {k}.", 1) for k in range(100)] + [(3, None, None, None, 0)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies int")
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append({r.conv_id: tuple(r) for r in turns.repair(d).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == 4
    assert results[0][3] == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_turns_table_is_small_and_lazy():
    auto = turns.Repairs()
    assert not auto.table
    assert len(auto.vectors()) == 30


def test_turns_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, row string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op12_turn_repair(spark, str(tmp_path)).count() == 0


# --- filter audit
def test_audit_as_sql(spark, tmp_path):
    texts = ["one two", "word " * 60, "A B C " * 30, "pay $5", None, "", "x" * 3, " ".join(str(k) for k in range(80)), "SHOUT " + " ".join(str(k) for k in range(90)), " ".join(f"w{k}" for k in range(50000))]
    docs = [(k, texts[rng.randrange(len(texts))], rng.choice(["s1", "s2", "", None]), "clash") for k in range(120)] + [(None, "one two", "s1", ""), (3, "one two", "s1", ""), (3, "one two", "s1", ""), (900, "fine", "alone", "")]
    labels = [(k, rng.randint(0, 1), rng.choice([0, 1, None])) for k in range(0, 100)] + [(5, 1, 1), (None, 1, 1)]
    got = compare(spark, tmp_path, interplay.op13_filter_audit, interplay.SQL, documents=(docs, "doc_id bigint, text string, source string, part string"), labels=(labels, "doc_id bigint, quality int, toxic int"))
    assert got.count() == 4 * 600


def test_audit_of_any_filters(spark):
    rows = [("p", rng.random() < 0.5, rng.random() < 0.3, None if rng.random() < 0.2 else rng.random() < 0.5, rng.random() < 0.5, 1) for _ in range(300)]
    got = interplay.audit(spark.createDataFrame(rows, "host string, short boolean, copy boolean, loud boolean, good boolean, alive int"), ["short", "copy", "loud"], ["good"], part="host").collect()
    assert len(got) == 18
    for r in got:
        order = {"short": 1, "copy": 2, "loud": 3}
        names = next(o for o in itertools.permutations(order) if "".join(o) == r.filter_order)
        alive = [x for x in rows if not any(x[order[f]] for f in names[: r.step - 1])]
        out = [x for x in alive if x[order[names[r.step - 1]]]]
        assert (r.kept, r.removed, r.good_lost) == (len(alive) - len(out), len(out), sum(x[4] for x in out))
        assert r.shapley == sum(x.removed for x in got if x.filter_order[x.filter_order.index(names[r.step - 1]) :] and next(o for o in itertools.permutations(order) if "".join(o) == x.filter_order)[x.step - 1] == names[r.step - 1])


def test_audit_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert interplay.op13_filter_audit(spark, str(tmp_path)).count() == 0
