"""Personal data: patterns propose, checksums confirm, words nearby adjust. Built-in functions only.

Every span is kind:begin:end in code points, end exclusive, with a score from 0 to 1. A kind's pattern
proposes spans, its check (number ranges, Luhn, mod 97) drops those that cannot be, and words
within CONTEXT code points on either side, up to the next proposal, raise or lower the score. The kinds of
BASE are kept at any score; those of ADDED, whose forms occur in ordinary text too, from LEAST up.

Patterns begin only where a run of their characters begins or where the last match ended, and take runs
possessively, so that a text is scanned in linear time and without recursion however long its runs
are. Both leave the matches of the plain patterns as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
LEAST = 0.6
RAISED = 0.3
LOWERED = 0.3

_CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits pass the Luhn check: every second one from the right doubled, nines cast out."""

    def total(digits: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(digits))

        def add(sum_: Column, i: Column) -> Column:
            digit = F.substr(digits, -i, F.lit(1)).cast("int")
            double = digit * 2
            return sum_ + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

        return F.aggregate(places, F.lit(0), add) % 10 == 0

    return let(digits_of(found), total)


def mod_97(found: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and A to Z read as 10 to 35, leave 1 modulo 97."""

    def rest(text: Column) -> Column:
        moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))

        def add(sum_: Column, char: Column) -> Column:
            return F.when(char.between("0", "9"), (sum_ * 10 + F.ascii(char) - 48) % 97).otherwise((sum_ * 100 + F.ascii(char) - 55) % 97)

        return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1

    return let(F.regexp_replace(found, "[^A-Z0-9]", ""), rest)


def _counted(least: int, most: int) -> Callable[[Column], Column]:
    return lambda found: F.length(digits_of(found)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test for texts that may hold a match; ``words`` and ``against`` are nearby words, as patterns."""

    name: str
    pattern: str
    hint: str
    score: float
    valid: Callable[[Column], Column]
    words: str
    against: str = "example|sample|dummy|test"


_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

# Matches equal those of the contract's patterns.
BASE = [
    Kind(
        "email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
        lambda found: F.lit(True), "e-?mail|contact|write to|mailto",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.6,
        lambda found: found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), r"\bip\b|address|host|server|login", "version|release|chapter|section",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}", 0.7,
        lambda found: _counted(13, 19)(found) & luhn(found), r"card|visa|credit|debit|payment|\bcvv\b", "order|tracking|isbn|serial",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, _counted(9, 15), r"phone|\btel\b|call|mobile|fax|whatsapp"),
]
_US_PHONE = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
ADDED = [
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]", 0.8,
        mod_97, r"\biban\b|account|bank|transfer|konto|cuenta|compte",
    ),
    Kind(
        "national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4,
        lambda found: found.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), r"\bssn\b|social security|tax id|taxpayer|identity",
    ),
    # International numbers are matched first, so that their tails are not taken for national ones.
    Kind(
        "local_phone", rf"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9.(-]){_US_PHONE}", r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", 0.4,
        lambda found: ~found.startswith("+"), r"phone|\btel\b|call|mobile|fax|whatsapp",
    ),
]
KINDS = [*BASE, *ADDED]

_SPANS = "array<struct<begin:int,end:int,score:double,found:string>>"


def _proposed(text: Column, kind: Kind) -> Column:
    """All matches with their places and the text around, by splitting the text around them.

    Places are running sums, made chunk by chunk: an accumulator is copied at each step, so one
    over all matches would cost the square of their number.
    """
    none = F.array().cast("array<struct<begin:int,end:int,found:string,near:string>>")

    def near(m: Column, i: Column) -> Column:
        return F.concat(F.substr(F.get(m["between"], i), F.lit(-CONTEXT)), F.lit("\n"), F.substr(F.get(m["between"], i + 1), F.lit(1), F.lit(CONTEXT)))

    def paired(m: Column) -> Column:
        return F.transform(m["found"], lambda f, i: F.struct(f.alias("found"), F.length(F.get(m["between"], i)).alias("skip"), F.length(f).alias("size"), near(m, i).alias("near")))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["skip"]
        item = F.struct(begin.alias("begin"), (begin + p["size"]).alias("end"), p["found"].alias("found"), p["near"].alias("near"))
        return F.struct((begin + p["size"]).alias("at"), F.concat(acc["all"], F.array(item)).alias("all"))

    def placed(pairs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int"))

        def chunk(c: Column) -> Column:
            return F.slice(pairs, c * _CHUNK + 1, _CHUNK)

        sums = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda a, p: a + p["skip"] + p["size"]))

        def from_sums(sums: Column) -> Column:
            def walk(c: Column) -> Column:
                at = F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda a, n: a + n)
                return F.aggregate(chunk(c), F.struct(at.alias("at"), none.alias("all")), step, lambda acc: acc["all"])

            return F.flatten(F.transform(chunks, walk))

        return F.when(F.size(pairs) > 0, let(sums, from_sums)).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("found"), F.split(text, kind.pattern, -1).alias("between"))
    return F.when(text.rlike(kind.hint), let(let(both, paired), placed)).otherwise(none)


def spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind with their scores, in order."""

    def scored(m: Column) -> Column:
        near = F.lower(m["near"])
        score = F.lit(kind.score) + F.when(near.rlike(kind.words), RAISED).otherwise(0.0) - F.when(near.rlike(kind.against), LOWERED).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
        return F.struct(m["begin"].alias("begin"), m["end"].alias("end"), score.alias("score"), m["found"].alias("found"))

    found = F.transform(F.filter(_proposed(text, kind), lambda m: kind.valid(m["found"])), scored)
    return found if kind in BASE else F.filter(found, lambda m: m["score"] >= LEAST)


def _listed(kinds: list[Kind]) -> Column:
    """Spans as kind:begin:end, kind by kind, comma-joined."""

    def texts(kind: Kind) -> Column:
        return F.transform(kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s["begin"], s["end"]))

    return F.concat_ws(",", *map(texts, kinds))


def find_personal(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, the spans of each kind as arrays of (begin, end, score, found),
    their counts ``n_...``, the listing of all spans and the digest of that of the BASE kinds.

    ``docs`` has doc_id and text; other columns are left out, whatever their names. Null is an empty text,
    without spans. Spans are listed kind by kind, as in KINDS, then by begin; spans of several kinds may overlap,
    and all are kept. Repeated rows give a row each; a table without rows none.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", *[spans(text, k).cast(_SPANS).alias(k.name) for k in KINDS])
    counts = {f"n_{k.name}": F.size(k.name).cast("long") for k in KINDS}
    return found.withColumns(counts | {"base_sha256": F.sha2(_listed(BASE), 256), "spans": _listed(KINDS)})


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with the text's spans of a score of ``least`` or more replaced by ``[kind]``.

    Of spans that overlap, the one that begins first names the replacement (the longest of several, then in the order of KINDS), and
    all of them go. Null stays null. Columns are kept, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(rank: int, kind: Kind) -> Column:
        chosen = F.filter(spans(text, kind), lambda s: s["score"] >= least)
        return F.transform(chosen, lambda s: F.struct(s["begin"].alias("begin"), (-s["end"]).alias("less"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind")))

    every = F.concat(*[named(i, k) for i, k in enumerate(KINDS)])

    def mask(acc: Column, s: Column) -> Column:
        opened = F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["begin"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["begin"] >= acc["at"], F.struct(s["end"].alias("at"), opened.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(F.array_sort(every), start, mask, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)))
    return docs.withColumn("text", masked)
