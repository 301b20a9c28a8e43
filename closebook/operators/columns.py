"""Header resolution: which source column stands for which canonical column."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.schemas import ALIASES

FUZZY_FLOOR = 90.0

# Tasks get this module's functions with the job, so executors need not have the package.
register_pickle_by_value(sys.modules[__name__])


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, start=1):
            above = row[j]
            row[j] = diagonal + 1 if x == y else max(above, row[j - 1])
            diagonal = above
    return row[-1]


def token_set_score(a: str, b: str) -> float:
    """0..100 similarity of two headers as sets of words; 100 if one set holds the other."""
    words_a, words_b = set(a.split()), set(b.split())
    if not words_a or not words_b:
        return 0.0
    shared = words_a & words_b
    if shared and (shared == words_a or shared == words_b):
        return 100.0
    only_a = " ".join(sorted(words_a - shared))
    only_b = " ".join(sorted(words_b - shared))
    base = len(" ".join(sorted(shared)))
    gap = 1 if shared else 0
    full_a, full_b = base + gap + len(only_a), base + gap + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * _common_length(only_a, only_b)
    scores = [100.0 * (1 - edits / (full_a + full_b))]
    if shared:
        scores += [100.0 * 2 * base / (base + full) for full in (full_a, full_b)]
    return max(scores)


def match_header(header: Sequence[str], target: Sequence[str], fuzzy: bool = True) -> dict[str, str]:
    """Canonical name -> source name for one header.

    Exact name, then aliases in their order, both ignoring case; then the most similar
    header that no other canonical column has claimed.
    """
    by_lower = {name.lower(): name for name in header}
    found: dict[str, str] = {}
    for want in target:
        for name in [want, *ALIASES.get(want, [])]:
            if name.lower() in by_lower:
                found[want] = by_lower[name.lower()]
                break
    for want in target if fuzzy else ():
        free = [name for name in header if name not in found.values()]
        if want in found or not free:
            continue
        best = max(free, key=lambda name: token_set_score(want, name))
        if token_set_score(want, best) >= FUZZY_FLOOR:
            found[want] = best
    return found


def resolve_columns(df: DataFrame, target: Sequence[str], fuzzy: bool = True) -> DataFrame:
    """Rename the columns that match ``target``; all others pass through unchanged."""
    found = match_header(df.columns, target, fuzzy)
    return df.withColumnsRenamed({source: want for want, source in found.items()})


def aliased_columns(df: DataFrame, target: Sequence[str], fuzzy: bool = True) -> int:
    """How many columns ``resolve_columns`` gives a new name."""
    found = match_header(df.columns, target, fuzzy)
    return sum(1 for want, source in found.items() if want not in df.columns and source != want)


def resolve_headers(
    headers: DataFrame, target: Sequence[str], fuzzy: bool = True, column: str = "header"
) -> DataFrame:
    """Add ``resolved`` (canonical -> source name) to a table with one header array per row.

    Each distinct header is matched once per task, on the executors.
    """
    wanted = tuple(target)

    @F.pandas_udf("map<string,string>")
    def resolved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[tuple[str, ...], dict[str, str]] = {}
        for batch in batches:
            for h in batch.map(tuple).unique():
                if h not in seen:
                    seen[h] = match_header(h, wanted, fuzzy)
            yield batch.map(lambda h: seen[tuple(h)])

    return headers.withColumn("resolved", resolved(F.col(column)))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Names in ``required`` that ``df`` lacks, in their order."""
    return [c for c in required if c not in df.columns]


def missing_in_headers(
    headers: DataFrame, required: Sequence[str], column: str = "header"
) -> DataFrame:
    """Add ``missing``: required names that the header array of each row lacks."""
    wanted = F.array(*[F.lit(c) for c in required])
    return headers.withColumn("missing", F.array_except(wanted, F.col(column)))


def add_missing(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each absent column with its default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
