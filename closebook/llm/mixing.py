"""Mixing sources to target weights. Built-in functions only.

A source with share p of all tokens gets weight p^a, normalised; a is between 1 (as it is) and 0
(all equal). Given a limit of repetitions, a is the smallest that keeps it; given an entropy of the
weights, the largest that reaches it. Each weight becomes a budget of tokens; a source's documents are dealt
by hash into blocks, and its budget takes whole passes over its blocks and then, in
an order that a hash gives each pass, every block that still fits in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.tables import set_aside
from closebook.operators.lookup import lookup_join
from closebook.session import staged

BLOCKS = 64
PARTS = 32
ROUNDS = 9
SEED = "mix"


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a source key that is never null, the document's tokens and its block."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    block = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % BLOCKS
    return docs.withColumns({"_source": source, "_tokens": token_count(), "_block": block})


def source_weights(blocks: DataFrame, repetitions: float | None = None, entropy: float | None = None) -> DataFrame:
    """(_source, tokens, weight, budget) of sources with tokens, from their blocks' counts.

    The budget is the least of which every source gets at least one pass: no document is lost.
    So source s is passed (p_s / p_max) ^ (a - 1) times.
    """
    sources = blocks.groupBy("_source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    total = sources.agg(F.sum("tokens").alias("_all"), F.max("tokens").alias("_most"))
    shares = staged(sources.join(F.broadcast(total)).withColumn("_share", F.col("tokens") / F.col("_all")), "shares")
    exponent = _exponent(shares, repetitions, entropy)
    powers = shares.agg(F.sum(F.pow("_share", F.lit(exponent))).alias("_norm"))  # one row
    passes = F.pow(F.col("tokens") / F.col("_most"), F.lit(exponent - 1.0))
    return shares.join(F.broadcast(powers)).select(
        "_source", "tokens", (F.pow("_share", F.lit(exponent)) / F.col("_norm")).alias("weight"),
        F.floor(F.col("tokens") * passes + 0.001).cast("long").alias("budget"),
    )


def _exponent(shares: DataFrame, repetitions: float | None, entropy: float | None) -> float:
    """Bisects the exponent between an end that meets the target and one that doesn't.

    A smaller exponent gives more repetitions and more entropy. Each round cuts the interval into
    PARTS and tries all cuts in one small query, so that few rounds do.
    """
    if (repetitions is None) == (entropy is None):
        raise ValueError("give either a limit of repetitions or an entropy")
    good, bad = (1.0, 0.0) if entropy is None else (0.0, 1.0)
    for _ in range(ROUNDS):
        cuts = [bad + (good - bad) * k / PARTS for k in range(PARTS)]
        tried = shares.select("*", F.posexplode(F.array(*map(F.lit, cuts))).alias("cut", "a"))
        power = F.pow("_share", F.col("a"))
        found = tried.groupBy("cut").agg(
            F.sum(power).alias("norm"), F.sum(power * F.log(power)).alias("plogp"),
            F.max(F.pow(F.col("tokens") / F.col("_most"), F.col("a") - 1.0)).alias("passes"),
        )
        meets = F.col("passes") <= repetitions if entropy is None else F.log("norm") - F.col("plogp") / F.col("norm") >= entropy
        first = found.filter(meets).agg(F.min("cut").alias("first")).first()["first"]
        if first == 0:
            return cuts[0]
        good, bad = (good, cuts[-1]) if first is None else (cuts[first], cuts[first - 1])
    return good


def _partial(blocks: DataFrame) -> DataFrame:
    """The blocks of the last pass that still fit in, in their order: each is taken that what is left of the budget holds."""
    listed = F.array_sort(F.collect_list(F.struct("_place", "_block", "_block_tokens"))).alias("_blocks")  # BLOCKS of a source
    sources = blocks.groupBy("_source", "_pass").agg(F.max("_rest").alias("_rest"), listed)
    none = F.struct(F.col("_rest").alias("left"), F.array().cast("array<int>").alias("taken"))

    def take(acc: Column, b: Column) -> Column:
        more = F.struct((acc["left"] - b["_block_tokens"]).alias("left"), F.concat(acc["taken"], F.array(b["_block"])).alias("taken"))
        return F.when(b["_block_tokens"] <= acc["left"], more).otherwise(acc)

    chosen = sources.select("_source", "_pass", F.posexplode(F.aggregate("_blocks", none, take, lambda acc: acc["taken"])).alias("_at", "_block"))
    return chosen.select("_source", "_block", "_pass", (F.col("_at") + 1).alias("_place"))


def realised_weights(taken: DataFrame) -> DataFrame:
    """(source, tokens, weight) of a mix as it came out, to hold against the weights aimed at."""
    sources = taken.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens").alias("_all"))
    return sources.join(F.broadcast(total)).select("source", "tokens", (F.col("tokens") / F.col("_all")).alias("weight"))


def mixed(docs: DataFrame, repetitions: float | None = None, entropy: float | None = None) -> DataFrame:
    """``docs`` with a row for each time a document is taken, and its place.

    Adds ``n_tokens``, ``pass_no`` from 1 and ``place``, the rank of its block in that pass (of the
    last, partial pass: of the blocks taken). Shuffling within blocks and over sources is up to the reader,
    who sorts by a hash of these. Every document is taken at least once: also those
    without tokens (null or empty texts), which cost nothing and are taken with their block.
    A null source is a source. Repeated rows count as often as they occur. Without rows, or with no tokens
    at all, each document is taken once. Input columns are kept, whatever their names, but for those added.
    """
    docs, named_back = set_aside(docs)
    keyed = _keyed(docs)
    blocks = staged(keyed.groupBy("_source", "_block").agg(F.sum("_tokens").alias("tokens")), "blocks")
    weights = source_weights(blocks, repetitions, entropy)
    plan = blocks.withColumnRenamed("tokens", "_block_tokens").join(weights, "_source", "left")
    plan = plan.withColumn("_full", F.coalesce(F.expr("budget div tokens"), F.lit(1)))
    plan = plan.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_full") + 1)))
    shuffled = Window.partitionBy("_source", "_pass").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "_pass", "_source", "_block")), "_block")
    rest = F.col("budget") - F.col("_full") * F.col("tokens")
    ordered = plan.withColumn("_place", F.row_number().over(shuffled)).withColumn("_rest", rest)
    whole = ordered.filter(F.col("_pass") <= F.col("_full")).select("_source", "_block", "_pass", "_place")
    taken = whole.unionByName(_partial(ordered.filter(F.col("_pass") > F.col("_full"))))
    passes = taken.groupBy("_source", "_block").agg(F.sort_array(F.collect_list(F.struct("_pass", "_place"))).alias("_passes"))
    found = lookup_join(keyed, staged(passes, "passes"), ["_source", "_block"])
    each = found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_tokens").alias("n_tokens"), F.explode("_passes").alias("_taken"))
    return named_back(each.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "pass_no", "place")], "n_tokens", F.col("_taken._pass").cast("long").alias("pass_no"), F.col("_taken._place").cast("long").alias("place")))
