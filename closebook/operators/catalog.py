"""The tutorial catalogue as two keyed tables: steps and toolsets.

steps(id, name, description), one row per name; toolsets(id, name, tutorial, tools), one row
per step name and tutorial. Either may have ``extra``, a JSON object of the entry's other fields,
which survives every merge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions import text as X
from closebook.operators.lookup import keep_last

IdMaker = Callable[..., Column]


def random_id(*key: Column) -> Column:
    """Fresh UUID. Differs on each evaluation: write the result once before reading it twice."""
    return F.uuid()


def keyed_id(*key: Column) -> Column:
    """UUID-shaped id derived from the key, the same in each run."""
    return X.canonical_uuid(F.md5(F.concat_ws("\x1f", *key)))


def clean_ids(df: DataFrame) -> DataFrame:
    """Canonical spelling for ids that are UUIDs; other ids stay as they are."""
    return df.withColumn("id", F.coalesce(X.canonical_uuid(F.col("id")), F.col("id")))


def _rest(df: DataFrame) -> list[str]:
    """The column of an entry's other fields, if the table has it."""
    return ["extra"] if "extra" in df.columns else []


def clean_steps(steps: DataFrame) -> DataFrame:
    return clean_ids(steps).select("id", "name", "description", *_rest(steps))


def clean_toolsets(toolsets: DataFrame) -> DataFrame:
    refs = clean_ids(toolsets).withColumn("tutorial", X.tutorial_ref(F.col("tutorial")))
    return refs.select("id", "name", "tutorial", "tools", *_rest(toolsets))


def other_fields(entry: str, known: Sequence[str]) -> Column:
    """The fields of a VARIANT object that are not ``known``, as a JSON object; NULL if there are none."""
    fields = F.expr(f"map_filter(try_variant_get({entry}, '$', 'map<string,variant>'), (k, v) -> k NOT IN ({', '.join(repr(k) for k in known)}))")
    return F.when(F.size(fields) > 0, F.to_json(fields, {"ignoreNullFields": "false"}))


def latest_steps(updates: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Last description registered per step name."""
    rows = updates.select(
        F.col("step_name").alias("name"), "description", F.struct(*order_by).alias("_order")
    )
    return keep_last(rows, ["name"], ["_order"]).drop("_order")


def latest_toolsets(updates: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Last tool list registered per step name and tutorial."""
    rows = updates.select(
        F.col("step_name").alias("name"),
        X.tutorial_ref(F.col("tutorial_path")).alias("tutorial"),
        "tools",
        F.struct(*order_by).alias("_order"),
    )
    last = keep_last(rows, ["name", "tutorial"], ["_order"])
    return last.select("name", "tutorial", X.tool_names(F.col("tools")).alias("tools"))


def _upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str, make_id: IdMaker) -> DataFrame:
    """Full outer merge on unique keys: old ids survive, new values replace old ones."""
    merged = old.join(new.withColumnRenamed(value, "_new").withColumn("_hit", F.lit(True)), keys, "full_outer")
    return merged.select(
        F.coalesce("id", make_id(*[F.col(k) for k in keys])).alias("id"),
        *keys,
        F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value)).alias(value),
        *_rest(old),
    )


def upsert_catalog(
    steps: DataFrame,
    toolsets: DataFrame,
    updates: DataFrame,
    order_by: Sequence[str],
    make_id: IdMaker = random_id,
) -> tuple[DataFrame, DataFrame]:
    """Register ``updates`` (step_name, description, tutorial_path, tools), in order.

    Both sides of each merge are unique by key, so no key is hot.
    """
    new_steps = _upsert(
        clean_steps(steps), latest_steps(updates, order_by), ["name"], "description", make_id
    )
    new_toolsets = _upsert(
        clean_toolsets(toolsets),
        latest_toolsets(updates, order_by),
        ["name", "tutorial"],
        "tools",
        make_id,
    )
    return new_steps, new_toolsets
