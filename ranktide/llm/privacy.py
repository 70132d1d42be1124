"""Personal data: keyed surrogates that keep type, gender, script and format.

Entities are found by one pattern with a branch for each kind: e-mail addresses, phone numbers,
IPv4 addresses, card numbers, and names after a title.  A distinct entity
gets one surrogate in the whole corpus, so mentions of one person stay one person:

* digits of phones and cards go through a keyed permutation of all numbers of their layout, with grouping, signs and a country code kept, so that they are
  distinct by construction and none is its own; one may be another number of the corpus, which then has another surrogate itself.  Card numbers keep their
  length and whether their Luhn check is right;
* an IPv4 address becomes four other octets;
* an address keeps its dots, its length class and a reserved top-level domain; equal local parts
  with other domains get unrelated surrogates;
* a name is put together for its title's gender and its own script from one surrogate for each distinct
  surname and one for each distinct first name, so a surname met with any title or first name is the same surname.
  These are settled in a table of their own: names that share one, or whose surname is one of the corpus, are drawn again from a
  name space that grows with each round, until all are distinct.

Names are found in Latin, Cyrillic and Greek script; a titled name of another script is left as it is.  Particles (``von``, ``van der``) stay.

Surrogates of addresses are checked for collisions: of the entities that share one, or whose surrogate is
itself an entity of the corpus, all but the first are hashed again with a higher attempt number, up to
``ATTEMPTS`` rounds, after which a distinct serial number from the hash makes the rest distinct.

Only distinct entities are shuffled; texts are cut at the entities, and put together again
with the surrogates looked up.

Nulls and edges: a null text stays null with no entity; text without entities is unchanged; repeated
rows get equal results; an empty table gives no rows; columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, written

ATTEMPTS = 4
#: Titles by gender, and the names drawn for either by script.
TITLES = {"m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Don", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "Sra", "Госпожа"], "n": ["Dr", "Prof", "Mx"]}
FIRST = {
    ("m", "latin"): ["James", "Peter", "Martin", "Lucas", "Oliver", "Daniel", "Victor", "Hugo", "Simon", "Julian", "Felix", "Adrian", "Robert", "Thomas", "Samuel", "Leon"],
    ("f", "latin"): ["Emma", "Clara", "Laura", "Julia", "Helena", "Alice", "Sophie", "Marta", "Irene", "Nora", "Lucia", "Anna", "Elena", "Sara", "Rosa", "Ida"],
    ("n", "latin"): ["Robin", "Alex", "Kim", "Sascha", "Jules", "Noel", "Andrea", "Charlie"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Андрей", "Павел", "Олег", "Максим", "Денис"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Вера", "Дарья", "Нина"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
    ("m", "greek"): ["Νίκος", "Πέτρος", "Μάριος", "Ιάσων"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Σοφία", "Ίριδα"],
    ("n", "greek"): ["Αλέξης", "Άρτεμις"],
}
LAST = {"latin": ["Archer", "Bennett", "Calder", "Dalton", "Ellery", "Fischer", "Garnier", "Hidalgo", "Iversen", "Jansen", "Keller", "Lorenz", "Marchand", "Navarro", "Olsen", "Prieto", "Quinn", "Renard", "Serrano", "Tanner", "Ulrich", "Vidal", "Weber", "Ximenes", "Young", "Zeller"], "cyrillic": ["Орлов", "Зимин", "Белов", "Громов", "Седов", "Лебедь", "Шевчук", "Коваль"], "greek": ["Δήμου", "Καλός", "Λάμπρος", "Ράλλης", "Σταύρου", "Μελάς"]}
#: Syllables of made-up names, 48 for Latin and Greek and 40 for Cyrillic script.
SYLLABLES = {"latin": [c + v for c in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t") for v in "aeio"], "cyrillic": [c + v for c in "бвгдлмнрст" for v in "аеио"], "greek": [c + v for c in "βγδζκλμνπρστ" for v in "αεηο"]}
_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t)))
EMAIL = r"[A-Za-z0-9\p{L}][A-Za-z0-9\p{L}._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: Scripts with names to draw; a titled name of another script is no entity.
_LETTER = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}"
PARTICLES = "von|van|der|den|de|del|della|di|da|du|la|le|zu|zur|ter|ten|af|av"
NAME = rf"(?<![\p{{L}}])(?:{_TITLE})\.?\x20(?=[{_LETTER}])\p{{Lu}}[{_LETTER}'’-]+(?:(?:\x20(?:{PARTICLES})){{0,3}}\x20(?=[{_LETTER}])\p{{Lu}}[{_LETTER}'’-]+)?"
ENTITY = f"{EMAIL}|{IP}|{CARD}|{PHONE}|{NAME}"
#: A text without a match of this has no entity; cheaper than ENTITY.
HINT = rf"@|\d[\d.() -]{{6}}|(?:{_TITLE})\.?\x20\p{{Lu}}"


def kind_of(e: Column) -> Column:
    return F.when(e.contains("@"), "email").when(e.rlike(f"^(?:{IP})$"), "ip").when(e.rlike(r"^\p{L}"), "name").when(F.length(F.regexp_replace(e, r"\D", "")).between(13, 19) & ~e.startswith("+"), "card").otherwise("phone")


def _hash(key: str, salt: str, e: Column, attempt: Column) -> Column:
    """Hex of a keyed hash: the key goes in on both sides."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(salt), attempt.cast("string"), e, F.lit(key)), 256)


def _pick(h: Column, at: int, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.conv(F.substring(h, at, 7), 16, 10).cast("bigint") % len(names) + 1).cast("int"))


def _refill(e: Column, digits: Column, keep: Column) -> Column:
    """The characters of e with its digits, after the first ``keep``, replaced by others."""
    chars = F.split(e, "")
    number = F.aggregate(chars, F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), lambda a, c: F.when(c.rlike("[0-9]"), F.struct((a["k"] + 1).alias("k"), F.concat(a["out"], F.when(a["k"] < keep, c).otherwise(F.substring(digits, a["k"] + 1, F.lit(1)))).alias("out"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["out"], c).alias("out"))))
    return number["out"]


def _luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, doubling every second digit from the last but one."""
    chars = F.reverse(F.split(d, ""))
    return F.aggregate(F.transform(chars, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def _permuted(number: Column, places: Column, layout: Column, key: str) -> Column:
    """Another number of so many digits, by a keyed permutation that has no fixed point.

    Four rounds of a Feistel network over the two halves of the number, one step on, and the rounds back: all numbers of a layout lie on one cycle.
    """
    e = F.struct(number.alias("x"), F.greatest(places, F.lit(1)).cast("int").alias("d"), layout.alias("f"))
    # a = 10^(digits of the left half), b = 10^(digits of the right half)
    half = lambda v: F.transform(F.array(v), lambda s: F.struct(s["f"].alias("f"), F.pow(F.lit(10.0), F.floor(s["d"] / 2)).cast("bigint").alias("a"), F.pow(F.lit(10.0), s["d"] - F.floor(s["d"] / 2)).cast("bigint").alias("b"), s["x"].alias("x")))

    def run(s: Column) -> Column:
        def step(v: Column, k: Column) -> Column:
            j, sign = F.when(k < 4, k).otherwise(8 - k), F.when(k < 4, 1).otherwise(-1)
            other = F.when(j % 2 == 0, v["r"]).otherwise(v["l"])
            h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), s["f"], j.cast("string"), other.cast("string"), F.lit(key)), 256), 1, 13), 16, 10).cast("bigint")
            on = F.pmod(v["l"] * s["b"] + v["r"] + 1, s["a"] * s["b"])
            left = F.when(k == 4, F.floor(on / s["b"])).when(j % 2 == 0, F.pmod(v["l"] + sign * F.pmod(h, s["a"]), s["a"])).otherwise(v["l"])
            right = F.when(k == 4, F.pmod(on, s["b"])).when(j % 2 == 1, F.pmod(v["r"] + sign * F.pmod(h, s["b"]), s["b"])).otherwise(v["r"])
            return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

        start = F.struct(F.floor(s["x"] / s["b"]).cast("bigint").alias("l"), F.pmod(s["x"], s["b"]).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(8)), start, step, lambda v: v["l"] * s["b"] + v["r"])

    return F.transform(half(e), run)[0]


def _number_surrogate(e: Column, kind: Column, key: str) -> Column:
    """Phones and cards: their digits permuted among all of their layout, so that they are distinct; a country code, and whether a card's check digit is right, stay."""
    digits = F.regexp_replace(e, r"\D", "")
    code = F.length(F.regexp_replace(F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])", 0), r"\D", ""))
    is_card = kind == "card"
    kept, last = F.when(is_card, 0).otherwise(code), F.when(is_card, 1).otherwise(0)
    places = F.length(digits) - kept - last
    free = F.substring(digits, kept + 1, places)
    layout = F.concat_ws("|", kind, F.substring(digits, F.lit(1), kept), F.translate(e, "123456789", "000000000"))
    new = F.lpad(_permuted(free.cast("bigint"), places, layout, key).cast("string"), places, F.lit("0"))
    off = F.pmod(_luhn_sum(digits), F.lit(10))  # how far the check digit is from the right one
    check = F.pmod(off - _luhn_sum(F.concat(new, F.lit("0"))), F.lit(10)).cast("string")
    return _refill(e, F.concat(F.substring(digits, F.lit(1), kept), new, F.when(is_card, check).otherwise("")), kept)


def surrogate(e: Column, kind: Column, attempt: Column, key: str) -> Column:
    """Of an e-mail or IPv4 address."""
    h = _hash(key, "e", e, attempt)
    octet = [(F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("int") % 254 + 1).cast("string") for i in range(4)]
    ip = F.concat_ws(".", *octet)
    local = F.regexp_extract(e, "^([^@]*)@", 1)
    dotted = F.when(local.contains("."), F.concat(_pick(h, 1, [x.lower() for x in FIRST["n", "latin"]]), F.lit("."), F.substring(h, 20, 6))).otherwise(F.concat(_pick(h, 1, [x.lower() for x in FIRST["n", "latin"]]), F.substring(h, 20, 6)))
    email = F.concat(dotted, F.lit("@mail"), F.substring(h, 40, 4), F.lit(".example"))
    return F.when(kind == "email", email).otherwise(ip)


def _made_up(h: Column, script: str, n: int) -> Column:
    """A name of n syllables, at most eight."""
    parts = F.concat(*[_pick(h, 1 + 7 * i, SYLLABLES[script]) for i in range(min(n, 8))])
    return F.concat(F.upper(F.substring(parts, 1, 1)), F.substring(parts, 2, 99))


def settled_names(parts: DataFrame, key: str) -> DataFrame:
    """Distinct (role, name) -> role, name, new: distinct within a role, and no new surname is a surname of the corpus.

    Roles are ``last-<script>`` and ``first-<gender>-<script>``.  A round's name space is 40 times that of the round before, or more.
    """
    open_ = written(parts.select("role", "name").distinct(), "pii-parts")
    known = open_.filter(F.col("role").startswith("last-")).select("role", F.col("name").alias("new"))
    done, attempt = None, 0
    while True:
        h = _hash(key, "part", F.concat_ws("|", "role", "name"), F.lit(attempt))
        new = F.lit(None).cast("string")
        for script, family in LAST.items():
            new = F.when(F.col("role") == f"last-{script}", _pick(h, 1, family) if attempt == 0 else _made_up(h, script, attempt + 2)).otherwise(new)
        for (g, script), names in FIRST.items():
            drawn = _pick(h, 57, names)
            new = F.when(F.col("role") == f"first-{g}-{script}", drawn if attempt == 0 else F.concat(drawn, F.lit("-"), _made_up(h, script, attempt + 1))).otherwise(new)
        tried = open_.withColumn("new", new)
        taken = known if done is None else known.unionByName(done.select("role", "new"))
        first = tried.groupBy("role", "new").agg(F.min("name").alias("owner")).join(taken, ["role", "new"], "left_anti")
        first = first.select(F.col("role").alias("r"), F.col("new").alias("n"), "owner")
        state = tried.join(first, (F.col("role") == F.col("r")) & (F.col("new") == F.col("n")) & (F.col("name") == F.col("owner")), "left")
        state = written(state.select("role", "name", "new", F.col("owner").isNotNull().alias("settled")), "pii-part-round")
        got = state.filter("settled").drop("settled")
        done = got if done is None else done.unionByName(got)
        open_ = state.filter("not settled").select("role", "name")
        if open_.isEmpty():
            return done
        attempt += 1


def name_surrogates(names: DataFrame, key: str) -> DataFrame:
    """Distinct (entity, kind) of titled names -> entity, kind, surrogate."""
    words = F.split("entity", " ")
    given = (F.size(words) > 2) & ~words[1].rlike(f"^(?:{PARTICLES})$")
    # title, given name, particles, family name; all but the first and the last may be missing
    middle = F.slice(words, F.when(given, 3).otherwise(2), F.greatest(F.size(words) - F.when(given, 3).otherwise(2), F.lit(0)))
    d = names.select("entity", "kind", words[0].alias("title"), F.when(given, words[1]).alias("given"), F.nullif(F.array_join(middle, " "), F.lit("")).alias("particles"), F.element_at(words, -1).alias("family"))
    bare = F.regexp_replace("title", r"\.$", "")
    gender = F.when(bare.isin(TITLES["m"]), "m").when(bare.isin(TITLES["f"]), "f").otherwise("n")
    script = F.when(F.col("family").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("family").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    d = d.withColumns({"last_role": F.concat(F.lit("last-"), script), "first_role": F.concat(F.lit("first-"), gender, F.lit("-"), script)})
    parts = d.select(F.col("last_role").alias("role"), F.col("family").alias("name")).union(d.filter("given is not null").select("first_role", "given"))
    table = settled_names(parts, key)
    d = d.join(table.toDF("last_role", "family", "new_family"), ["last_role", "family"])
    d = d.join(table.toDF("first_role", "given", "new_given"), ["first_role", "given"], "left")
    return d.select("entity", "kind", F.concat_ws(" ", "title", "new_given", "particles", "new_family").alias("surrogate"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (entity) -> entity, kind, surrogate, with surrogates distinct, and none of an address an entity.

    A round costs a pass over the entities that are still open; the settled ones are written.
    """
    open_ = written(entities.select("entity", kind_of(F.col("entity")).alias("kind")).distinct(), "pii-entities")
    names = written(name_surrogates(open_.filter("kind = 'name'"), key), "pii-names")
    numbers = open_.filter("kind in ('phone', 'card')")
    numbers = numbers.withColumn("surrogate", _number_surrogate(F.col("entity"), F.col("kind"), key))
    open_ = open_.filter("kind in ('email', 'ip')")
    known = open_.select(F.col("entity").alias("surrogate"))
    done = None
    for attempt in range(ATTEMPTS + 1):
        tried = open_.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), F.lit(attempt), key))
        if attempt == ATTEMPTS:  # few are left; the hash of the entity itself sets them apart
            tried = tried.withColumn("surrogate", F.concat("surrogate", F.lit("-"), F.substring(F.sha2(F.concat(F.lit(key), "entity"), 256), 1, 16)))
        first = tried.groupBy("surrogate").agg(F.min("entity").alias("owner"))
        taken = known if done is None else known.unionByName(done.select("surrogate"))
        first = first.join(taken, "surrogate", "left_anti")
        state = written(tried.join(first.withColumnRenamed("surrogate", "s"), (F.col("surrogate") == F.col("s")) & (F.col("entity") == F.col("owner")), "left").select("entity", "kind", "surrogate", F.col("owner").isNotNull().alias("settled")), "pii-round")
        settled = state.filter("settled").select("entity", "kind", "surrogate")
        done = settled if done is None else done.unionByName(settled)
        open_ = state.filter("not settled").select("entity", "kind")
        if open_.isEmpty():
            break
    return done.unionByName(names).unionByName(numbers)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, ...) -> the same with ``text`` rewritten, and n_entities.

    Texts without an entity go through untouched and are not shuffled.  Others are cut into pieces; the distinct
    entities of a text look up their surrogates, come back as one map for each row, and the pieces
    are joined in order.
    """
    found = docs.withColumn("_e", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))))
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "pii-found")
    some = F.coalesce(F.size("_e"), F.lit(0)) > 0
    mentions = found.filter(some).select("_row", F.explode(F.array_distinct("_e")).alias("entity"))
    table = surrogates(mentions.select("entity"), key)
    of_row = mentions.join(table, "entity").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"))
    cut = found.filter(some).join(of_row, "_row")
    pieces = F.split("text", ENTITY, -1)
    text = F.array_join(F.zip_with(pieces, F.transform("_e", lambda e: F.col("_map")[e]), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    cut = cut.withColumn("text", text).withColumn("n_entities", F.size("_e").cast("bigint")).drop("_e", "_row", "_map")
    rest = found.filter(~some).withColumn("n_entities", F.lit(0).cast("bigint")).drop("_e", "_row")
    return rest.unionByName(cut)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates in place of personal data, n_entities."""
    return replace(documents(spark, sf_dir).select("doc_id", "text"), key="ranktide-surrogates").select("doc_id", "text", "n_entities")
