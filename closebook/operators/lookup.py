"""Lookups: a wide fact table joined to a side that has at most one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_PIECE = 100_000
NULL_PIECES = 1_000_000


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``. Combines before the shuffle, so no hot key."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, "last.*")


def measured_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Counts rows and bytes of ``df`` (one small job) and says whether it may be broadcast."""
    width = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    size = df.agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    small: bool | None = None,
    counted: DataFrame | None = None,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Join ``facts`` to ``lookup``, which holds each key at most once.

    A lookup measured as small is broadcast, so the facts do not move. Any other lookup is
    shuffled, with hot keys of the facts cut into pieces (see ``salted_join``). Pass ``small``
    when the size is already known or when measuring would read a large table. A lookup made
    from the facts is best ``staged`` first, so that measuring it does not make it twice.
    """
    if measured_small(lookup) if small is None else small:
        return facts.join(F.broadcast(lookup), list(on), how)
    return salted_join(facts, lookup, on, how, counted, rows_per_piece)


def hot_keys(facts: DataFrame, on: Sequence[str], rows_per_piece: int) -> DataFrame:
    """Keys that need more than one piece, with the number of pieces.

    These are the keys with more rows than a piece and than an equal share of a shuffle
    partition. There are fewer of them than shuffle partitions, and any other key fits a task.
    """
    shares = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.dropna(subset=list(on)).groupBy(*on).agg(F.count("*").alias("_rows"))
    share = counts.agg(F.sum("_rows") / shares).scalar()
    return counts.filter((F.col("_rows") > rows_per_piece) & (F.col("_rows") > share)).select(
        *on, F.ceil(F.col("_rows") / rows_per_piece).cast("int").alias("_pieces")
    )


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Shuffled lookup join in which a hot key is spread over many tasks.

    Each hot key gets one piece per ``rows_per_piece`` rows. Its facts go to pieces by a hash
    of the row, which a rerun task repeats exactly; its one lookup row is copied to every
    piece. Equal rows share a piece; adaptive skew handling may still split that one.
    Keys are counted on ``counted``, by default the facts; pass an earlier stage of the facts
    with the same keys where that is cheaper to compute. Rows with a NULL key match nothing and are spread over NULL_PIECES.
    By hint, only the hot keys themselves are broadcast, fewer rows than shuffle partitions; Spark may
    broadcast the lookup too when it finds it below its own threshold.
    """
    hot = F.broadcast(hot_keys(facts if counted is None else counted, on, rows_per_piece))
    row_hash = F.xxhash64(*_hashed(facts))
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    pieces = F.when(keyless, NULL_PIECES).otherwise(F.coalesce("_pieces", F.lit(1)))
    piece = F.pmod(row_hash, pieces.cast("long")).cast("int")
    copies = F.when(
        F.col("_pieces").isNotNull(), F.sequence(F.lit(0), F.col("_pieces") - 1)
    ).otherwise(F.array(F.lit(0)))
    salted_facts = facts.join(hot, list(on), "left").withColumn("_piece", piece).drop("_pieces")
    salted_lookup = (
        lookup.join(hot, list(on), "left").withColumn("_piece", F.explode(copies)).drop("_pieces")
    )
    return salted_facts.join(salted_lookup, [*on, "_piece"], how).drop("_piece")


def _hashed(df: DataFrame) -> list[Column]:
    """The scalar columns of ``df``, which tell its rows apart and are cheap to hash."""
    nested = ("variant", "map", "array", "struct")
    scalars = [F.col(f"`{name}`") for name, kind in df.dtypes if not kind.startswith(nested)]
    return scalars or [F.to_json(F.struct("*"))]
