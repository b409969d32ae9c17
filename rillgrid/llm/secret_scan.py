"""Secret scan with a trigram index.

Each rule is a regular expression.  From its syntax a Boolean query over trigrams is derived: an OR of
sets, every match containing all trigrams of one of the sets (case ignored).  The index lists, for the
trigrams that any rule asks for, the documents that contain them; the posting lists of a set are
intersected by counting, and only documents that meet a rule's query are verified with its expression.
A rule without mandatory trigrams is verified on all documents.

Spans are found without user functions: the gaps between matches (split) and the matches
(extract all) alternate, so running sums of their lengths are the offsets, in code points.

Edge cases: a null text counts as empty and has no spans.  Rows that share id and text are found
together and keep their number; a null id is kept.  Spans of different kinds may overlap.  An empty table gives no
rows; extra columns are kept, a column named like the result is replaced.
"""

from __future__ import annotations

import re._parser as syntax
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.llm.common import ascii_lower, let
from rillgrid.staging import settle

GRAM = 3
MANY = 64  # strings of an exact set, beyond which it is reduced to its trigrams
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters of group ``group``, else the match is dropped
    group: int = 0


# kinds that every result has, in the order in which spans with the same start are listed
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a run that is too short has no longer match inside
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A key runs over its header lines and key lines, of which the last may be short, and the END marker that follows them; anything
# else after the BEGIN marker is text and stays.  Line breaks may be escaped.  Java recurses in loops over groups, so lines are read by a loop over
# characters; only lines that are indented or set apart by blanks need groups (240 of them, unless the marker follows).
_BREAK, _KEY = r"[\x20\t\r\nrn\\]+", r"[A-Za-z0-9+/]{16,}"
_HEADERS = rf"(?:{_BREAK}[A-Z][A-Za-z-]{{1,30}}:\x20[^\r\n\\]*){{0,8}}"
_LINES = rf"{_BREAK}{_KEY}(?:[A-Za-z0-9+/=\r\n\\]*(?:[\r\n]|\\n){_KEY})?={{0,2}}" + rf"(?:{_BREAK}{_KEY}={{0,2}}){{0,60}}" * 4
_END = rf"{_BREAK}-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
_PEM = rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_HEADERS}{_LINES}(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}{_END}|{_END}|(?:\r?\n|\\n)[A-Za-z0-9+/]{{1,15}}={{0,2}})?)?"

# formats that providers publish for their keys
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", _PEM),
)
RULES = BASE + MORE

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; the query that holds an empty set is always true
ALL: Query = frozenset([frozenset()])


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))


def _both(a: Query, b: Query) -> Query:
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MANY else a


def _either(a: Query, b: Query) -> Query:
    return ALL if frozenset() in a | b else a | b


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which every match of ``pattern`` contains whole."""

    def of_exact(strings: frozenset[str]) -> Query:
        found = frozenset(_grams(s) for s in strings)
        return ALL if frozenset() in found or not found else found

    def sequence(parts) -> tuple[frozenset[str] | None, Query]:
        """(the strings that the parts match, or None if there are too many; a query)"""
        exact: frozenset[str] = frozenset([""])
        query, closed = ALL, True
        for op, value in parts:
            own, asked = one(op, value)
            if own is not None and len(exact) * len(own) <= MANY:
                exact = frozenset(a + b for a in exact for b in own)
                continue
            query = _both(_both(query, of_exact(exact)), asked if own is None else of_exact(own))
            exact, closed = frozenset([""]), False
        return (exact, ALL) if closed else (None, _both(query, of_exact(exact)))

    def one(op, value) -> tuple[frozenset[str] | None, Query]:
        name = str(op)
        if name == "LITERAL":
            return frozenset([chr(value).lower()]), ALL
        if name == "IN":
            chars: set[str] = set()
            for kind, x in value:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, ALL
            return (frozenset(chars), ALL) if len(chars) <= 8 else (None, ALL)
        if name == "SUBPATTERN":
            return sequence(value[3])
        if name == "BRANCH":
            exact: set[str] | None = set()
            query: Query | None = None
            for branch in value[1]:
                own, asked = sequence(branch)
                asked = asked if own is None else of_exact(own)
                query = asked if query is None else _either(query, asked)
                exact = None if own is None or exact is None else exact | own
            return (frozenset(exact), ALL) if exact is not None and len(exact) <= MANY else (None, query)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            own, asked = sequence(inner)
            if own is not None and (least, most) in ((0, 1), (1, 1)):
                return own | (frozenset([""]) if least == 0 else frozenset()), ALL
            if least == 0:
                return None, ALL
            return None, asked if own is None else of_exact(own)
        if name == "AT":
            return frozenset([""]), ALL
        return None, ALL

    exact, query = sequence(syntax.parse(pattern))
    return query if exact is None else of_exact(exact)


def postings(keyed: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: (gram, _id, _h) for the ``wanted`` trigrams that a row's ``_low`` contains."""
    has = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in wanted]))
    return keyed.select("_id", "_h", F.explode(has).alias("gram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(_id, _h, kinds) of the rows that meet the query of some rule with mandatory trigrams, each once."""
    needs: dict[str, list[int]] = {}
    sets: list[tuple[str, int]] = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if frozenset() in query:
            continue
        for grams in sorted(query, key=sorted):
            for g in grams:
                needs.setdefault(g, []).append(len(sets))
            sets.append((rule.kind, len(grams)))
    if not sets:
        return None
    asked = F.create_map(*[x for g, numbers in sorted(needs.items()) for x in (F.lit(g), F.array(*map(F.lit, numbers)))])
    listed = postings(keyed, sorted(needs)).distinct().select("_id", "_h", F.explode(F.element_at(asked, F.col("gram"))).alias("number"))
    size = F.element_at(F.array(*[F.lit(n) for _, n in sets]), F.col("number") + 1)
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in sets]), F.col("number") + 1)
    met = listed.groupBy("_id", "_h", "number").count().where(F.col("count") == size)  # in every posting list of the set
    return met.groupBy("_id", "_h").agg(F.collect_set(kind).alias("_kinds"))


def matches(text: Column, rule: Rule) -> Column:
    """(start, end, kind) of the matches of ``rule`` from left to right, as an array."""

    def spans(found: Column, gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))

        def step(s: Column, m: Column) -> Column:
            def put(b: Column) -> Column:
                long_enough = F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
                e = b + F.length(m)
                span = F.array(F.struct(b.alias("start"), e.alias("end"), F.lit(rule.kind).alias("kind")))
                return F.struct(e.alias("at"), (s["i"] + 1).alias("i"), F.when(long_enough, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

            return let(s["at"] + F.length(F.get(gaps, s["i"])), put)

        return F.aggregate(found, start, step, lambda s: s["out"])

    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    both = let(found, lambda f: let(F.split(text, rule.pattern, -1), lambda g: spans(f, g)))
    return F.when(text.rlike(rule.pattern), both).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the column ``out``: (start, end, kind) of all rules by start, then by the rule's place in the table."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out])  # apart from the names used here
    keyed = docs.select(own.alias("own"), body.alias("_body"), F.col(f"`{key}`").alias("_id"), F.xxhash64(body).alias("_h"))
    found = candidates(keyed.select("_id", "_h", ascii_lower(F.col("_body")).alias("_low")), rules)
    free = {r.kind for r in rules if frozenset() in trigram_query(r.pattern)}
    if found is not None:
        named = settle(found, "candidates").select(F.col("_id").alias("_i"), F.col("_h").alias("_j"), "_kinds")
        keyed = keyed.join(named, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_j")), "left").drop("_i", "_j")
    else:
        keyed = keyed.withColumn("_kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    asked = lambda kind: F.coalesce(F.array_contains("_kinds", F.lit(kind)), F.lit(False))
    parts = [matches(F.col("_body"), r) if r.kind in free else F.when(asked(r.kind), matches(F.col("_body"), r)).otherwise(empty) for r in rules]
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    order = F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return keyed.select("own", spans.alias("spans")).select("own.*", F.col("spans").alias(out))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with each run of overlapping ``spans`` (by start) replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        out = F.when(apart, F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
