"""Secret scan: fixed patterns, and windows of high entropy. Built-in functions only.

Every span is kind:begin:end in code points, end exclusive. ``assign``, ``access`` and ``hex`` are
patterns. ``entropy`` spans are candidates, runs of key characters of at least WINDOW characters
with a digit and a letter, in which some window has a Shannon entropy, over the character class of
the run, of at least that class's threshold. A window moves one character at a time: the sum of
count * log2(count) is corrected for the character that enters and the one that leaves.
Allow-listed runs (ids and paths by form, long repeats, placeholders) are no candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20


@dataclass(frozen=True)
class Kind:
    """A pattern, the cheap test for a text that may hold it, and which matches count.

    Of the runs behind ``access`` and ``hex`` only a whole one can be long enough, so their patterns ask
    for the length; a match of ``assign`` that is too short still takes its text.
    """

    name: str
    pattern: str
    hint: str
    keep: str = ""


# The patterns of the contract.
_WORDS = "(?i:password|passwd|secret|token|api_?key)"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
KINDS = [
    Kind("assign", _WORDS + _SIGN + "[A-Za-z0-9+/_.=-]+", _WORDS + _SIGN + "[A-Za-z0-9+/_.=-]{6}", "^" + _WORDS + _SIGN + "[A-Za-z0-9+/_.=-]{6,}$"),
    Kind("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}"),
    Kind("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Least entropy, in bits a character of a window, by character class of the run.
THRESHOLDS = {"hex": 3.0, "letters_digits": 3.6, "base64": 3.7}

# Forms that are no secrets: UUIDs, paths and dashed words, one character again and again, placeholders.
ALLOWED = [
    r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"^[A-Za-z]*([/_=+-]+[A-Za-z]+)*[/_=+-]*[0-9]{0,4}$",
    r"^(.{1,3})\1+$",
    r"(?i)(example|placeholder|changeme|xxxx|0123456789|1234567890)",
]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, hint: str) -> str:
    """Array of (begin, end, found) of all matches, by splitting the text around them."""
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    between = f"split({text}, {_quoted(pattern)}, -1)"
    step = "struct(acc.at + length(p.b) + length(p.f) AS at, concat(acc.all, array(struct(acc.at + length(p.b) AS begin, acc.at + length(p.b) + length(p.f) AS end, p.f AS found))) AS all)"
    pairs = "zip_with(m.found, slice(m.between, 1, size(m.found)), (f, b) -> struct(f, b))"
    none = "cast(array() AS array<struct<begin:int,end:int,found:string>>)"
    walk = f"aggregate({pairs}, struct(0 AS at, {none} AS all), (acc, p) -> {step}, acc -> acc.all)"
    return f"CASE WHEN {text} RLIKE {_quoted(hint)} THEN get(transform(array(struct({found} AS found, {between} AS between)), m -> {walk}), 0) ELSE {none} END"


def _spans(kind: Kind, text: str) -> str:
    all_of_it = _matches(text, kind.pattern, kind.hint)
    return f"filter({all_of_it}, m -> m.found RLIKE {_quoted(kind.keep)})" if kind.keep else all_of_it


def _windowed(run: str, threshold: str) -> str:
    """Whether some window of WINDOW characters of ``run`` has the entropy asked for.

    The state holds the count of each character seen in the run and the window's sum of c log2 c.
    """
    w = WINDOW
    clog = "CASE WHEN {c} > 1 THEN {c} * log2({c}) ELSE 0D END"

    def change(state: str, char: str, by: int) -> str:
        old = f"coalesce(element_at({state}.counts, {char}), 0)"
        new = f"({old} {'+' if by > 0 else '-'} 1)"
        counts = f"map_concat(map_filter({state}.counts, (k, v) -> k <> {char}), map({char}, {new}))"
        return f"struct({counts} AS counts, {state}.total - {clog.format(c=old)} + {clog.format(c=new)} AS total, {state}.best AS best)"

    first = "struct(cast(map() AS map<string,int>) AS counts, 0D AS total, 0D AS best)"
    enter = f"get(transform(array(s), e -> {change('e', f'substr({run}, i, 1)', 1)}), 0)"
    leave = f"get(transform(array({enter}), e -> CASE WHEN i > {w} THEN {change('e', f'substr({run}, i - {w}, 1)', -1)} ELSE e END), 0)"
    measure = f"get(transform(array({leave}), e -> struct(e.counts AS counts, e.total AS total, CASE WHEN i >= {w} THEN greatest(e.best, log2({w}) - e.total / {w}) ELSE e.best END AS best)), 0)"
    return f"aggregate(sequence(1, length({run})), {first}, (s, i) -> {measure}, s -> s.best >= {threshold})"


def entropy_spans(text: str) -> str:
    allowed = " OR ".join(f"m.found RLIKE {_quoted(p)}" for p in ALLOWED)
    mixed = "m.found RLIKE '[0-9]' AND m.found RLIKE '[A-Za-z]'"
    runs = _matches(text, CANDIDATE, r"[A-Za-z0-9+/_=-]{20}")
    likely = f"filter({runs}, m -> {mixed} AND NOT ({allowed}))"
    t = THRESHOLDS
    least = f"CASE WHEN m.found RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN {t['hex']}D WHEN m.found RLIKE '^[A-Za-z0-9]+$' THEN {t['letters_digits']}D ELSE {t['base64']}D END"
    return f"filter({likely}, m -> {_windowed('m.found', least)})"


def _listed(column: str) -> Column:
    """Spans as kind:begin:end, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_spans and all_spans
    as arrays of (begin, rank, end, kind, found), their digest and listing.

    ``docs`` has doc_id and text; other columns are left out. Null is an empty text, without
    spans. Spans are ordered by begin, then assign, access, hex, entropy. Spans of several
    kinds may overlap; all are kept. Repeated rows give a row each; a table without rows none.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        found = found.withColumn(kind.name, F.expr(_spans(kind, "text")))
    found = found.withColumn("entropy", F.expr(entropy_spans("text"))).drop("text")

    def ranked(names: list[str]) -> Column:
        parts = [f"transform({n}, s -> struct(s.begin AS begin, {i} AS rank, s.end AS end, '{n}' AS kind, s.found AS found))" for i, n in enumerate(names)]
        return F.expr(f"array_sort(concat({', '.join(parts)}))")

    base = [k.name for k in KINDS]
    spans = found.select(
        "doc_id", *(F.size(n).cast("long").alias(f"n_{n}") for n in [*base, "entropy"]),
        ranked(base).alias("base_spans"), ranked([*base, "entropy"]).alias("all_spans"),
    )
    return spans.withColumns({"base_sha256": F.sha2(_listed("base_spans"), 256), "spans": _listed("all_spans")})


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; overlapping ones by one."""
    names = docs.columns
    found = docs.withColumns({f"_{k.name}": F.expr(_spans(k, "coalesce(text, '')")) for k in KINDS})
    found = found.withColumn("_entropy", F.expr(entropy_spans("coalesce(text, '')")))
    every = "array_sort(concat(" + ", ".join([*(f"_{k.name}" for k in KINDS), "_entropy"]) + "))"
    step = f"CASE WHEN s.begin >= a.at THEN struct(s.end AS at, concat(a.out, substr(text, a.at + 1, s.begin - a.at), {_quoted(mask)}) AS out) ELSE struct(greatest(a.at, s.end) AS at, a.out AS out) END"
    masked = f"aggregate({every}, struct(0 AS at, '' AS out), (a, s) -> {step}, a -> concat(a.out, substr(text, a.at + 1)))"
    return found.withColumn("text", F.expr(masked)).select(*names)
