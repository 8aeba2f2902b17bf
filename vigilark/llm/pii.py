"""Personal data: fixed patterns, and identifiers that bootstrapped contexts reveal.

DataFrame operations only. Emails, IP addresses, card and phone numbers are found by pattern and
checked (number ranges, Luhn digits). Each checked span is one seed: it is masked as a whole, so its
context lies outside it. Long hexadecimal words are weak seeds (kind 'secret'): they teach contexts
like the others but are reported only where a trusted context brings them up.

Around every token that looks like an identifier stand lexical patterns: the words before and behind
it. Patterns and instances form a bipartite graph on which confidence is passed to and fro, kind by
kind: a pattern is as good as the share of its distinct instances that are trusted, an unknown
instance as good as the patterns that bring it up. After some rounds, what only good and well
supported patterns bring up is a new span. An instance counts once per pattern however many copies
of its text there are.

The expressions below match what the plain ones match, written so that no text makes Java's matcher
recurse or start over inside one run of characters; everything done with the matches of one text
takes time in proportion to them (times a logarithm).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm._tables import release, settle

KINDS = ("email", "ip", "card", "phone")
FOUND, SECRET = "id", "secret"
#: Rounds of the graph, trusted instances a pattern needs, confidence of what counts as trusted,
#: and the confidence from which a pattern passes trust on.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, PASSING = 3, 3, 0.8, 0.5
#: Characters before and behind a token in which its context words are sought.
CONTEXT_CHARS = 64
#: Parts that the rows of one pattern or instance are dealt to in joins.
SALTS = 16

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # the local part starts a run of its characters, or where the last match ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with single separators, of the lengths that can pass
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# Masks: the printable ASCII characters of a span, moved to a block of the last private-use plane.
_MASK, _BLOCK = 0x10F000, 0x100
_PLAIN = "".join(map(chr, range(32, 127)))
_MASKED = {k: "".join(chr(_MASK + _BLOCK * n + ord(c)) for c in _PLAIN) for n, k in enumerate(KINDS)}
_ANY = rf"\x{{{_MASK:X}}}-\x{{{_MASK + _BLOCK * len(KINDS) - 1:X}}}"
TOKEN = rf"(?<!\S)[^\s0-9@{_ANY}]*+[0-9@{_ANY}]\S*+"
_CORE = r"(?s)[\p{L}0-9+](?:.*[\p{L}0-9])?"
_HEX = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,64}$"
_WORD = r"\p{L}+|[=:]"

_SPAN = "struct<kind:string,start:int,end:int,value:string,like:string,weak:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of `value` pass: every second from the right is doubled."""
    back = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(
        F.filter(back, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int"))
        .when(d.cast("int") < 5, d.cast("int") * 2)
        .otherwise(d.cast("int") * 2 - 9),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def running_sum(numbers: Column) -> Column:
    """Sums of all numbers up to each: each pass adds what stands 1, 2, 4, ... places before."""
    steps = F.transform(
        F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")
    )
    return F.aggregate(
        steps, numbers, lambda sums, d: F.transform(sums, lambda x, i: x + F.when(i >= d, F.get(sums, i - d)).otherwise(0))
    )


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at all matches: structs of the gap before a match, the match (`value`), and
    the code point where it ends. What follows the last match is a gap without a value."""
    cut = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def place(c: Column) -> Column:
        sizes = F.zip_with(c["gap"], c["value"], lambda g, v: F.char_length(g) + F.coalesce(F.char_length(v), F.lit(0)))
        return F.arrays_zip(c["gap"].alias("gap"), c["value"].alias("value"), running_sum(sizes).alias("end"))

    return _let(cut, place)


def _matches(kind: str) -> Column:
    """Pieces of `__text` at the matches of one kind with their check; null where none can be."""
    text = F.col("__text")
    sign = {"email": "@", "phone": "+"}.get(kind)
    may = text.contains(sign) if sign else text.rlike(PATTERNS[kind])
    checked = F.transform(
        pieces(text, PATTERNS[kind]),
        lambda p: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), p["end"].alias("end"), F.coalesce(p["value"].isNotNull() & _CHECKS[kind](p["value"]), F.lit(False)).alias("ok")),
    )
    return F.when(may, checked)


def _spans(found: Column, kind: str) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.transform(
        F.filter(found, lambda p: p["ok"]),
        lambda p: F.struct(
            F.lit(kind).alias("kind"), (p["end"] - F.char_length(p["value"])).alias("start"), p["end"].alias("end"), p["value"].alias("value"), F.lit(kind).alias("like"),
            F.lit(False).alias("weak"),
        ),
    )
    return F.coalesce(spans, none)


def _mask(found: Column, kind: str) -> Column:
    """The text with the spans of one kind masked; null where there are none."""
    hidden = lambda p: F.when(p["ok"], F.translate(p["value"], _PLAIN, _MASKED[kind])).otherwise(F.coalesce(p["value"], F.lit("")))
    return F.when(F.exists(found, lambda p: p["ok"]), F.array_join(F.transform(found, lambda p: F.concat(p["gap"], hidden(p))), ""))


def _paint(under: Column, over: Column, part: int = 1 << 16) -> Column:
    """`under` with what is masked in `over` masked too, part by part of the text."""

    def both(begin: Column) -> Column:
        chars = lambda t: F.split(F.substring(t, begin, F.lit(part)), "")
        return F.array_join(F.zip_with(chars(under), chars(over), lambda u, o: F.when(u.rlike(f"^[{_ANY}]"), u).otherwise(o)), "")

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(under), F.lit(1)), F.lit(part)), both), "")


def with_masks(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with `__text` (null: empty), `__base` (checked spans of all kinds, by kind as
    listed, then start) and `__masked`: the text, place for place, with these spans masked.

    Characters of the masks' own range, U+10F000 to U+10F3FF, count as U+FFFD.
    """
    plain = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select("*", F.when(plain.rlike(f"[{_ANY}]"), F.regexp_replace(plain, f"[{_ANY}]", "�")).otherwise(plain).alias("__text"))
    rows = rows.select("*", *[F.when(F.col("__text").rlike("[0-9@]"), _matches(k)).alias(f"__{k}") for k in KINDS])
    masks = F.filter(F.array(*[_mask(F.col(f"__{k}"), k) for k in KINDS]), lambda m: m.isNotNull())
    rows = rows.select(
        *docs.columns, "__text", F.concat(*[_spans(F.col(f"__{k}"), k) for k in KINDS]).alias("__base"), masks.alias("__masks")
    )
    joined = F.aggregate(F.slice(F.col("__masks"), 2, len(KINDS)), F.element_at("__masks", 1), lambda under, over: _paint(under, over))
    return rows.select(*docs.columns, "__text", "__base", F.when(F.size("__masks") == 0, F.col("__text")).otherwise(joined).alias("__masked"))


def _tokens(masked: Column) -> Column:
    """Tokens that look like identifiers, seeds among them, with the patterns around each."""

    def patterns(w: Column, edge: Column, after_edge: Column) -> Column:
        before = [F.coalesce(F.try_element_at(w["before"], F.lit(-k)), edge) for k in (2, 1)]
        behind = [F.coalesce(F.try_element_at(w["behind"], F.lit(k)), after_edge) for k in (1, 2)]
        around = ([*before, F.lit("_")], [before[1], F.lit("_"), behind[0]], [F.lit("_"), *behind])
        return F.filter(F.array(*[F.concat_ws(" ", *a) for a in around]), lambda p: p.rlike(r"\p{L}\p{L}"))

    def one(pair: Column, i: Column) -> Column:
        here, following = pair["here"], pair["following"]
        token = here["value"]
        hidden = token.rlike(f"[{_ANY}]")
        core = F.when(hidden, F.regexp_extract(token, f"[{_ANY}]+", 0)).otherwise(F.regexp_extract(token, _CORE, 0))
        words = F.struct(
            F.regexp_extract_all(F.lower(F.right(here["gap"], F.lit(CONTEXT_CHARS))), F.lit(_WORD), F.lit(0)).alias("before"),
            F.regexp_extract_all(F.lower(F.left(following["gap"], F.lit(CONTEXT_CHARS))), F.lit(_WORD), F.lit(0)).alias("behind"),
        )
        edges = F.when(i == 0, "^").otherwise("#"), F.when(following["value"].isNull(), "$").otherwise("#")
        kind = F.element_at(F.array(*map(F.lit, KINDS)), F.floor((F.ascii(core) - _MASK) / _BLOCK).cast("int") + 1)
        head = F.char_length(F.regexp_extract(token, r"^[^\p{L}0-9+]*", 0))
        start = here["end"] - F.char_length(token) + F.when(hidden, 0).otherwise(head)
        value = F.when(hidden, F.translate(core, "".join(_MASKED.values()), _PLAIN * len(KINDS))).otherwise(core)
        return F.struct(
            i.alias("at"), start.alias("start"), (start + F.char_length(core)).alias("end"), value.alias("value"), hidden.alias("base"),
            F.when(hidden, kind).when(core.rlike(_HEX), SECRET).alias("kind"), _let(words, lambda w: patterns(w, *edges)).alias("patterns"),
        )

    def all_of(cut: Column) -> Column:
        pairs = F.arrays_zip(cut.alias("here"), F.slice(cut, F.lit(2), F.size(cut)).alias("following"))
        return F.filter(F.transform(F.filter(pairs, lambda p: p["here"]["value"].isNotNull()), one), lambda t: t["end"] > t["start"])

    return _let(pieces(masked, TOKEN), all_of)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (hash of the text), checked spans and identifier-like tokens of every row."""
    rows = with_masks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    looks = F.col("__text").rlike("[0-9@]")  # all tokens hold one of these
    return rows.select("id", _mark(F.col("text")).alias("mark"), F.col("__base").alias("base"), F.when(looks, _tokens(F.col("__masked"))).alias("tokens"))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def seen_tokens(scanned: DataFrame) -> DataFrame:
    """One row per token: `id`, `mark`, its number `at`, place, value, kind of seed, patterns."""
    return scanned.select("id", "mark", F.explode("tokens").alias("t")).select("id", "mark", "t.*")


def _salted(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on `key` whose rows on the left are dealt to SALTS parts by `by`, so that a key that
    a third of them hold is not one task's. The right side has few rows of each key; it is never broadcast, since
    its size is reckoned from its files, before it is repeated."""
    parts = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return left.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(parts, [key, "_part"]).drop("_part")


def trusted_patterns(seen: DataFrame) -> DataFrame:
    """`pattern`, `like` (kind of its seeds), `confidence`: what the graph of patterns and instances
    trusts. `seen` holds `patterns`, `value` and the seed's `kind`, null if unknown.

    Links are summed up to one row per pattern and instance first, so a context or an identifier that
    a third of all texts hold is as light as any other.
    """
    links = (
        seen.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    )
    links = settle(links, columnar=True)
    degrees = settle(links.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SEEDS), columnar=True)
    seeds = settle(links.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("like")).withColumn("trust", F.lit(1.0)), columnar=True)
    trust, edges = seeds, links.select("pattern", "value")
    found = None
    for _ in range(ROUNDS):
        sums = (
            _salted(edges, trust, "value", "pattern")
            .groupBy("pattern", "like")
            .agg(F.sum("trust").alias("trust"), F.count(F.when(F.col("trust") >= MIN_CONFIDENCE, 1)).alias("support"))
            .filter(F.col("support") >= MIN_SEEDS)
        )
        # rounded, so that the order of summing does not matter
        last = found
        found = settle(sums.join(degrees, "pattern").select("pattern", "like", F.round(F.col("trust") / (F.col("n") + 0.5), 9).alias("confidence")), columnar=True)
        if trust is not seeds:
            release(last, trust)
        passing = found.filter(F.col("confidence") >= PASSING)
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        passed = _salted(edges, passing, "pattern", "value").groupBy("value", "like").agg(F.round(1 - F.exp(doubt), 9).alias("trust"))
        trust = settle(seeds.select("value", "like", "trust").unionByName(passed).groupBy("value", "like").agg(F.max("trust").alias("trust")), columnar=True)
    release(links, degrees, seeds, trust)
    return found.filter(F.col("confidence") >= MIN_CONFIDENCE)


def _discover(scanned: DataFrame) -> DataFrame:
    """`id_f`, `mark_f`, `fresh`: the discovered spans of each text, with their token's number."""
    seen = seen_tokens(scanned)
    good = settle(trusted_patterns(seen))
    rows = seen.filter(~F.col("base")).select("id", "mark", "at", "start", "end", "value", F.col("kind").isNotNull().alias("weak"), F.explode("patterns").alias("pattern"))
    best = F.max_by("like", F.struct("confidence", "like")).alias("like")
    found = _salted(rows, good, "pattern", "mark").groupBy("id", "mark", "at", "start", "end", "value", "weak").agg(best)
    spans = F.array_sort(F.collect_list(F.struct("at", F.lit(FOUND).alias("kind"), "start", "end", "value", "like", "weak")))
    return found.groupBy(F.col("id").alias("id_f"), F.col("mark").alias("mark_f")).agg(spans.alias("fresh"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `mark` (xxhash64 of the text), `base` and `spans`, one row per row of `docs`.

    Spans are structs of kind, start, end (code points, end exclusive), value, `like` and `weak`; `base`
    holds the checked ones by kind as listed, then start, and `spans` those and the discovered
    ones (kind 'id', `like` the kind of the seeds whose contexts revealed them), which never overlap
    the checked ones. A discovered span is `weak` if it looks like a secret by itself, a seed that only
    trusted contexts bring out; others were unseen before. Null and empty texts have none; repeated rows and rows with a null id get
    the spans of their text like others; an empty table gives an empty result; other columns are
    not read.
    """
    scanned = settle(scan(docs, id_col, text_col), columnar=True)
    same = F.col("id").eqNullSafe(F.col("id_f")) & (F.col("mark") == F.col("mark_f"))
    rows = scanned.select("id", "mark", "base").join(_discover(scanned), same, "left")
    fresh = F.coalesce(F.transform("fresh", lambda s: s.dropFields("at")), F.array().cast(f"array<{_SPAN}>"))
    return rows.select(F.col("id").alias(id_col), "mark", "base", F.concat("base", fresh).alias("spans"))


def describe(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; all columns and rows stay.

    Checked spans that overlap or touch give one mark, that of the first. A null text stays null, and
    so does every text without spans. Repeated rows and rows with a null id are redacted like
    others; an empty table stays empty.
    """
    scanned = settle(scan(docs, id_col, text_col), columnar=True)
    fresh = settle(_discover(scanned), columnar=True)
    release(scanned)
    numbers = fresh.select("id_f", "mark_f", F.transform("fresh", lambda s: s["at"]).alias("__at"))
    rows = with_masks(docs, text_col)
    same = rows[id_col].eqNullSafe(numbers["id_f"]) & (_mark(rows[text_col]) == numbers["mark_f"])
    joined = rows.join(numbers, same, "left")

    def replaced(cut: Column) -> Column:
        # for each token whether it goes: as many times no as there are tokens since the last that goes
        before = F.concat(F.array(F.lit(-1)), F.col("__at"))
        going = F.flatten(
            F.transform(
                F.filter(F.arrays_zip(F.col("__at").alias("here"), before.alias("last")), lambda p: p["here"].isNotNull()),
                lambda p: F.concat(F.array_repeat(F.lit(False), p["here"] - p["last"] - 1), F.array(F.lit(True))),
            )
        )
        token = lambda p: F.when(p["goes"], F.regexp_replace(p["cut"]["value"], _CORE, f"[{FOUND.upper()}]")).otherwise(F.coalesce(p["cut"]["value"], F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(cut.alias("cut"), going.alias("goes")), lambda p: F.concat(p["cut"]["gap"], token(p))), "")

    clean = F.when(F.col("__at").isNotNull(), _let(pieces(F.col("__masked"), TOKEN), replaced)).otherwise(F.col("__masked"))
    for n, kind in enumerate(KINDS):
        own = rf"\x{{{_MASK + _BLOCK * n:X}}}-\x{{{_MASK + _BLOCK * (n + 1) - 1:X}}}"
        clean = F.regexp_replace(clean, f"(?<![{_ANY}])[{own}][{_ANY}]*+", f"[{kind.upper()}]")
    clean = F.when((F.size("__base") > 0) | F.col("__at").isNotNull(), clean).otherwise(F.col(text_col))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
