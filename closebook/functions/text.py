"""Text expressions for letters, support lines and the tutorial catalogue."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, for both the regular expressions and trim().
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that start the descriptive tail of a tool name.
TOOL_TAIL_WORDS = ["mock", "sandbox", "integration", "automation", "workflow", "templating"]

MERGE_KEYS = ["ClientName", "ClientID", "FiscalYear", "ServiceSummary", "GeneratedOn"]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def non_empty(c: Column) -> Column:
    """NULL for the empty string; a blank of spaces is kept."""
    return F.nullif(c, F.lit(""))


def fill_path(template: Column, values: Mapping[str, Column | str]) -> Column:
    """Replace each ``{key}`` of a path template held in a column."""
    for key, value in values.items():
        value = F.lit(value) if isinstance(value, str) else value
        template = F.replace(template, F.lit("{" + key + "}"), value)
    return template


def slugify(name: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore."""
    slug = F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(non_empty(slug), F.lit("client"))


def letter_file(name: Column, fiscal_year: Column) -> Column:
    return F.concat(slugify(name), F.lit("_EngagementLetter_FY"), fiscal_year, F.lit(".docx"))


def rate_display(rate: Column) -> Column:
    """``$1,250.50`` for anything that reads as a number, else the text as it came."""
    text = strip(F.translate(rate, "$,", ""))
    number = F.when(
        text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        text.try_cast("double"),
    )
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return (
        F.when(number.isNotNull(), F.concat(F.lit("$"), F.format_number(number, 2)))
        .when(text.rlike("^(?i)[+-]?nan$"), F.lit("$nan"))
        .when(text.rlike("^(?i)[+-]?inf(inity)?$"), F.concat(F.lit("$"), sign, F.lit("inf")))
        .otherwise(rate)
    )


def merge_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Literal ``{{Key}}`` replacement in MERGE_KEYS order; later keys see earlier inserts."""
    for key in MERGE_KEYS:
        template = F.replace(template, F.lit("{{" + key + "}}"), values[key].cast("string"))
    return template


def complete_letter(base: Column, values: Mapping[str, Column]) -> Column:
    """Merged letter, with the summary and the year added where the text lacks them."""
    summary, year = values["ServiceSummary"], F.concat(F.lit("FY"), values["FiscalYear"])
    merged = merge_template(base, values)
    with_summary = F.when(F.contains(base, F.lit("{{ServiceSummary}}")), merged).otherwise(
        F.concat(rstrip(merged), F.lit("\n\nService Summary:\n"), summary, F.lit("\n"))
    )
    return F.when(F.contains(with_summary, year), with_summary).otherwise(
        F.concat(rstrip(with_summary), F.lit("\n\nFiscal Year: "), year, F.lit("\n"))
    )


def quoted_list(names: Column) -> Column:
    """``['a', 'b']`` for messages."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def row_line(columns: list[Column]) -> Column:
    """All cells of a row joined by `` | ``; a NULL cell keeps its place."""
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(" | ", *cells)


def tool_name(tool: Column) -> Column:
    """Tool name without its descriptive tail (``X mock API integration`` -> ``X``)."""
    spaced = F.trim(F.regexp_replace(tool, WS + "+", " "))
    tail = "(?is) (" + "|".join(TOOL_TAIL_WORDS) + ").*$"
    return F.trim(F.regexp_replace(spaced, tail, ""))


def tool_names(tools: Column) -> Column:
    """Simplified tool names, blanks dropped, first occurrence of each kept in order."""
    return F.array_distinct(F.filter(F.transform(tools, tool_name), lambda t: t != ""))


def tutorial_ref(path: Column) -> Column:
    """Tutorial path in clean form and without a leading ``notebooks`` folder."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = path.startswith("/")
    below = F.when(
        ~rooted & (F.get(parts, F.lit(0)) == "notebooks"), F.slice(parts, F.lit(2), F.size(parts))
    ).otherwise(parts)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(below, "/"))


def canonical_uuid(value: Column) -> Column:
    """Dashed lower-case form of any usual UUID spelling; NULL for other text."""
    bare = F.replace(F.replace(value, F.lit("urn:")), F.lit("uuid:"))
    digits = F.lower(F.replace(F.trim(bare, F.lit("{}")), F.lit("-")))
    dashed = F.regexp_replace(
        digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed)
