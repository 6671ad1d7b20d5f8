"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over trigrams (alternatives of
trigrams that must all occur). The index holds a posting (trigram, row) for every trigram that some
rule asks for; postings are intersected by counting, per row and alternative, how many of its
trigrams are there. Only rows that satisfy a rule's query are searched with its regex. A rule
without mandatory trigrams, such as long runs of hex digits, searches all rows where they lie.
"""

from __future__ import annotations

import re._constants as code
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import fresh, joined_small

#: Candidates are broadcast up to this many rows (counted first) and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: More literal alternatives than this make a part of a regex count as unknown.
MOST_ALTERNATIVES = 64
UNKNOWN = "\0"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. Lengths of at least 24 and 16 more are part of the patterns, which
# finds the same spans, as runs are maximal; the first rule keeps its check, as failing matches
# use up their text.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Published token formats.
ADDED = (
    # the whole block where its END line follows, else the header
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
)
RULES = BASE + ADDED
# What redaction hides is as in RULES, but private keys go as a whole: to their END line or, where
# that is missing, to the end of the headers and base64 lines. The loops are possessive and bounded.
KEY_GAP = r"(?:[\s>#*|\"',+-]|\\[nrt])"
KEY_LINES = rf"(?:{KEY_GAP}{{0,40}}+(?:[A-Za-z][A-Za-z-]{{1,30}}+:\x20[^\r\n]*+|[A-Za-z0-9+/]{{40,}}+={{0,2}}+|[A-Za-z0-9+/]{{2,39}}+(?:={{1,2}}+|(?=[\x20\t\"',]*+(?:[\r\n\\]|$))))){{0,1000}}+"
KEY_END = r"[^-]*+(?:-(?!----)[^-]*+){0,400}+-----END [A-Z ]{0,20}PRIVATE KEY(?:\x20BLOCK)?-----"
HIDDEN = tuple(Rule(r.kind, rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?:\x20BLOCK)?-----(?:{KEY_END}|{KEY_LINES})") if r.kind == "private_key" else r for r in RULES)


def _literals(nodes) -> list[str]:
    """What a parsed regex must contain: alternatives of literal text, with UNKNOWN where it can be anything."""
    found = [""]
    for op, arg in nodes:
        if op is code.LITERAL:
            part = [chr(arg)]
        elif op is code.IN and len(arg) <= 8 and all(kind is code.LITERAL for kind, _ in arg):
            part = [chr(c) for _, c in arg]
        elif op is code.BRANCH:
            part = [x for branch in arg[1] for x in _literals(branch)]
        elif op is code.SUBPATTERN:
            part = _literals(arg[3])
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            least, most, inner = arg
            inner = _literals(inner)
            if (least, most) == (0, 1) and all(UNKNOWN not in x for x in inner):
                part = ["", *inner]
            elif least == 0:
                part = [UNKNOWN]
            elif most == least == 1:
                part = inner
            else:
                part = [x + UNKNOWN for x in inner]
        elif op is code.AT:
            part = [""]
        else:
            part = [UNKNOWN]
        found = [a + b for a in found for b in dict.fromkeys(part)] if len(found) * len(part) <= MOST_ALTERNATIVES else [a + UNKNOWN for a in found]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams, one of which a matching text must hold in full; [] if a
    match is possible without any trigram."""
    sets = {frozenset(run[i : i + 3].lower() for run in text.split(UNKNOWN) for i in range(len(run) - 2)) for text in _literals(parser.parse(pattern))}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def candidates(rows: DataFrame, text: str, keys: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """`keys` and `_rules` (numbers of the rules to search) of the rows that satisfy some rule's query."""
    alternatives = [(r, a, sorted(grams)) for r, rule in enumerate(rules) for a, grams in enumerate(trigram_query(rule.pattern))]
    grams = sorted({g for *_, own in alternatives for g in own})
    # each gram of an alternative is one bit, so that repeated rows change nothing
    asked = [(grams.index(g), r, a, 1 << bit, (1 << len(own)) - 1) for r, a, own in alternatives for bit, g in enumerate(own)]
    queries = rows.sparkSession.createDataFrame(asked, "_gram int, _rule int, _alternative int, _bit long, _all long")
    low = rows.select(*keys, F.lower(text).alias("_low"))
    present = F.array_compact(F.array(*(F.when(F.col("_low").contains(g), F.lit(n)) for n, g in enumerate(grams))))
    postings = low.select(*keys, F.explode(present).alias("_gram"))
    hits = postings.join(F.broadcast(queries), "_gram").groupBy(*keys, "_rule", "_alternative", "_all").agg(F.bit_or("_bit").alias("_bits"))
    return hits.where("_bits = _all").groupBy(*keys).agg(F.collect_set("_rule").alias("_rules"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, end, number) of a rule's matches in code points: matches alternate with
    the pieces that splitting at them leaves."""
    pattern = F.lit(rule.pattern)
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    each = F.arrays_zip(matches.alias("m"), gaps.alias("g"), checked.alias("c"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(number).alias("kind"))
        keep = F.length(x["c"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    # the piece behind the last match pairs with no match
    walk = F.aggregate(F.filter(each, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda state: state["spans"])
    return F.when(text.rlike(rule.pattern), walk).otherwise(empty)


def _named(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `secret_spans`: array of (start, end, kind number) by start, then rule order.

    A null text counts as empty and has no spans; an id may be null or repeated (rows of one id
    and one text share their postings, rows of one id and different texts do not). All other columns
    stay, whatever their names; a column named `secret_spans` is replaced.
    """
    second = fresh(docs, "_text_key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, keyed = fresh(docs, "_id_key"), fresh(docs, "_rules")
    rows = docs.drop("secret_spans").withColumns({key: F.xxhash64(id_col), second: F.xxhash64(text)})
    found = candidates(rows, text_col, [key, second], rules).withColumnRenamed("_rules", keyed)
    joined = joined_small(rows, found, [key, second], "left", BROADCAST_ROWS)
    each = [_spans(text, rule, n) if not trigram_query(rule.pattern) else F.when(F.array_contains(keyed, n), _spans(text, rule, n)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int>>")) for n, rule in enumerate(rules)]
    by_place = F.array_sort(F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = F.transform(by_place, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.withColumn("secret_spans", spans).select(*[c for c in docs.columns if c != "secret_spans"], "secret_spans")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, the base spans' digest, all spans, `n_added`."""
    kinds, base = [r.kind for r in RULES], len(BASE)
    found = scan_secrets(docs.select(id_col, text_col), id_col, text_col).select(id_col, "secret_spans")
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(n).alias(f"n_{rule.kind}") for n, rule in enumerate(BASE)]
    own = F.filter("secret_spans", lambda s: s["kind"] < base)
    return found.select(id_col, *counts, F.sha2(_named(own, kinds), 256).alias("base_sha256"), _named(F.col("secret_spans"), kinds).alias("spans"), (F.size("secret_spans") - F.size(own)).cast("long").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span of the text replaced by `mark`; overlapping spans become one.
    Of a private key the whole block goes, not its header alone.

    Texts without spans, null ones too, stay as they are.
    """
    spans, held = fresh(docs, "_spans"), fresh(docs, "_held")
    found = scan_secrets(docs.withColumnRenamed("secret_spans", held), id_col, text_col, HIDDEN).withColumnRenamed("secret_spans", spans).withColumnRenamed(held, "secret_spans")
    text = F.col(text_col)

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    cleaned = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text)).drop(spans)
