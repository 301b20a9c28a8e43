"""Merkle manifest of a dataset, and proofs of its rows by a recursive query.

Each row is a leaf. The leaves of a group, sorted, form a tree of FANOUT children a node; the
groups' roots, sorted by group, form a last tree, whose root stands for the dataset. Digests are
kept as 32 bytes and hashed as lowercase hex text.

A tree is built STRIDE levels at a time: the FANOUT ** STRIDE nodes of a block meet in one row,
which holds all tiers of the block. Stored nodes are the leaves and each block's top. A
node is linked to its block's top, and keeps on that link the siblings of all tiers
between. So the recursive query ascends STRIDE levels a step, and a row is shuffled once a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.operators.lookup import lookup_join, measured_small
from closebook.session import staged

FANOUT = 3
STRIDE = 6
PIECES = 64  # copies of upper nodes, which many rows look up, where nodes are not broadcast
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
TOP = -1  # number of the tree over the groups' roots

_IN_PARTITION = 33  # bits of a monotonic id below the partition number


@dataclass
class Manifest:
    """``leaves`` are rows with their link; ``nodes`` are all other stored nodes with theirs.

    A link is (up_tree, up_level, up_idx, path), null and empty for the root; ``path`` has the digests left and right of
    the node's line of ancestors, from tier to tier. ``blocks`` hold every built tier.
    """

    leaves: DataFrame
    nodes: DataFrame
    blocks: DataFrame
    root: bytes | None
    stride: int


def digest(data: Column) -> Column:
    """SHA-256 of the lowercase hex text of ``data``, some digests one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(data)), 256))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values' texts, each behind its length in bytes; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` sorted by range, staged, with ``row_no`` from 0. Offsets come from the counts of partitions."""
    rows = staged(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", _IN_PARTITION).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition only
    offsets = rows.groupBy(part).agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit(2**_IN_PARTITION - 1))
    found = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn("row_no", F.col("_before") + within).drop("_id", "_part", "_before")


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def _tiers(digests: Column, whole: Column, stride: int) -> Column:
    """All tiers over the digests: ``stride`` more, or if they are the whole tree, until one node remains."""

    def above(tier: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(tier) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda r: digest(_joined(F.slice(tier, r * FANOUT + 1, FANOUT))))

    def grow(tiers: Column, _: Column) -> Column:
        last = F.element_at(tiers, -1)
        return F.when(whole & (F.size(last) == 1), tiers).otherwise(F.concat(tiers, F.array(above(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(stride)), F.array(digests), grow)


def _path(tiers: Column, place: Column) -> Column:
    """Siblings left and right of a node and of its ancestors, from tier to tier below the last."""

    def beside(tier: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FANOUT), k)).cast("int")
        first = at - at % FANOUT
        return F.struct(_joined(F.slice(tier, first + 1, at - first)).alias("left"), _joined(F.slice(tier, at + 2, first + FANOUT - 1 - at)).alias("right"))

    return F.transform(F.slice(tiers, 1, F.size(tiers) - 1), beside)


def _blocks(nodes: DataFrame, level: int, stride: int) -> DataFrame:
    """Nodes (tree, n, idx, digest, carried) of one level, gathered in blocks, with the tiers over each."""
    size = FANOUT**stride
    members = F.array_sort(F.collect_list(F.struct("idx", "digest", "carried"))).alias("members")
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / size).alias("block")).agg(F.max("n").alias("n"), members)
    tiers = _tiers(F.transform("members", lambda m: m["digest"]), F.col("n") <= size, stride)
    return grouped.select("tree", F.lit(level).alias("level"), "block", "n", "members", tiers.alias("tiers"))


def _grow(nodes: DataFrame, stride: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each level of all trees, and (tree, digest) of their roots."""
    levels, roots = [], []
    size = FANOUT**stride
    while True:
        blocks = staged(_blocks(nodes, len(levels) * stride, stride), name)
        levels.append(blocks)
        tops = blocks.select("tree", "n", F.col("block").alias("idx"), F.get(F.element_at("tiers", -1), F.lit(0)).alias("digest"))
        roots.append(tops.filter(F.col("n") <= size).select("tree", "digest"))
        upper = tops.filter(F.col("n") > size)
        if upper.isEmpty():
            return levels, reduce(DataFrame.unionByName, roots)
        carried = F.lit(None).cast(blocks.schema["members"].dataType.elementType["carried"].dataType)
        nodes = upper.select("tree", F.ceil(F.col("n") / size).alias("n"), "idx", "digest", carried.alias("carried"))


def _linked(blocks: DataFrame, stride: int, up_tree: Column, up_idx: Column) -> DataFrame:
    """A row for each member of the blocks, with its link; that of a tree's last block is given."""
    whole = F.col("n") <= FANOUT**stride
    rows = F.explode(F.transform("members", lambda m, i: F.struct(m["idx"].alias("idx"), m["digest"].alias("digest"), m["carried"].alias("carried"), _path(F.col("tiers"), i).alias("path")))).alias("m")
    ups = blocks.withColumns({
        "up_tree": F.when(whole, up_tree).otherwise(F.col("tree")), "up_idx": F.when(whole, up_idx).otherwise(F.col("block")),
        "up_level": F.when(whole, F.when(up_idx.isNotNull(), F.lit(0))).otherwise(F.col("level") + stride),
    })
    return ups.select("tree", "level", "up_tree", "up_level", "up_idx", rows).select("tree", "level", "m.*", "up_tree", "up_level", "up_idx")


def build(docs: DataFrame, columns: Sequence[str], key: str = "doc_id", group: str = "source", seen: dict[str, Column] | None = None, stride: int = STRIDE) -> Manifest:
    """The manifest of ``docs``: a leaf for each row, a tree for each ``group``, a tree over the groups.

    ``columns`` are hashed, in this order; other columns are left out, whatever their names. Leaves of a group are sorted by key,
    nulls first, then by digest, so rows with equal keys have an order of their own and equal
    rows are leaves each. Nulls are values. Groups are sorted null first, then by bytes; null is a group.
    ``seen`` gives columns as they are read now where they differ; the leaf of these values is kept
    as ``seen`` for the climb. A table without rows has no root.
    """
    values = [F.col(f"`{c}`") for c in columns]
    now = [(seen or {}).get(c, v) for c, v in zip(columns, values)]
    leaves = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("grp"), leaf_digest(values).alias("digest"), leaf_digest(now).alias("seen"))
    ordered = numbered(staged(leaves, "leaves"), ["grp", "key", "digest", "seen"], "ordered")
    ordered = ordered.withColumn("grp", F.coalesce(F.concat(F.lit("s"), F.col("grp")), F.lit("n")))
    # A tree's number is the row number of its first leaf, so trees are sorted as their groups are.
    trees = staged(ordered.groupBy("grp").agg(F.min("row_no").alias("tree"), F.count("*").alias("n")), "trees")
    placed = lookup_join(ordered, trees, ["grp"]).withColumn("idx", F.col("row_no") - F.col("tree"))
    levels, roots = _grow(placed.select("tree", "n", "idx", "digest", F.struct("key", "seen", "row_no").alias("carried")), stride, "blocks")
    tops = staged(numbered(roots, ["tree"], "roots").select("tree", "digest", F.col("row_no").alias("up_idx")), "tops")
    n = F.lit(tops.count()).cast("long")
    nothing = F.lit(None).cast(levels[0].schema["members"].dataType.elementType["carried"].dataType)
    above, root = _grow(tops.select(F.lit(TOP).cast("long").alias("tree"), n.alias("n"), F.col("up_idx").alias("idx"), "digest", nothing.alias("carried")), stride, "top_blocks")
    blocks = reduce(DataFrame.unionByName, levels + above)

    def links(below: DataFrame) -> DataFrame:
        known = lookup_join(below, tops.select("tree", F.col("up_idx").alias("_top_idx")), ["tree"])
        return _linked(known, stride, F.lit(TOP).cast("long"), F.col("_top_idx"))

    none = F.lit(None).cast("long")
    upper = [links(b) for b in levels[1:]] + [_linked(b, stride, none, none) for b in above]
    nodes = staged(reduce(DataFrame.unionByName, upper).drop("carried"), "nodes")
    found = root.first()
    return Manifest(links(levels[0]), nodes, blocks, bytes(found["digest"]) if found else None, stride)


def node_rows(manifest: Manifest) -> DataFrame:
    """Every built node: tree, level, idx, digest and parent, the idx of its parent on the next level.

    A tree's root has no parent. The trees' roots are level 0 of tree TOP as well.
    """
    stride = manifest.stride
    below = manifest.blocks.select("tree", "level", "block", "n", F.size("tiers").alias("height"), F.posexplode("tiers").alias("up", "tier"))
    rows = below.filter((F.col("up") < F.col("height") - 1) | (F.col("n") <= FANOUT**stride))
    first = F.col("block") * F.pow(F.lit(FANOUT), F.lit(stride) - F.col("up")).cast("long")
    each = rows.select("tree", (F.col("level") + F.col("up")).alias("level"), first.alias("first"), (F.col("up") < F.col("height") - 1).alias("below"), F.posexplode("tier").alias("at", "digest"))
    idx = F.col("first") + F.col("at")
    return each.select("tree", "level", idx.alias("idx"), "digest", F.when(F.col("below"), F.floor(idx / FANOUT)).alias("parent"))


_FOLD = "aggregate({path}, {start}, (f, s) -> unhex(sha2(lower(hex(concat(s.left, f, s.right))), 256)))"
_SIBLINGS = "aggregate({path}, X'', (p, s) -> concat(p, s.left, s.right))"


def climb(manifest: Manifest, small: bool | None = None) -> DataFrame:
    """A row per leaf: key, leaf, subroot, proof and folded, as bytes.

    ``proof`` has the siblings of the leaf and its ancestors up to the root, ``folded`` the root that ``seen``
    and these siblings give. Nodes measured as small are broadcast; else they are joined by
    shuffle, those that many rows look up in PIECES copies. ``small`` says which.
    """
    spark = manifest.nodes.sparkSession
    nodes = manifest.nodes
    if measured_small(nodes) if small is None else small:
        nodes, same_piece = F.broadcast(nodes), ""
    else:
        few = (F.col("tree") != TOP) & (F.col("level") == manifest.stride)  # looked up by the leaves of one block
        pieces = F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(PIECES - 1)))
        nodes = nodes.withColumn("piece", F.explode(pieces))
        same_piece = f"AND n.piece = IF(c.up_tree <> {TOP} AND c.up_level = {manifest.stride}, 0, pmod(c.row_no, {PIECES}))"
    query = f"""
      WITH RECURSIVE climb AS (
        SELECT carried.key AS key, carried.row_no AS row_no, digest AS leaf, CAST(NULL AS BINARY) AS subroot, {_SIBLINGS.format(path='path')} AS proof,
          {_FOLD.format(path='path', start='carried.seen')} AS folded, up_tree, up_level, up_idx
        FROM {{leaves}}
        UNION ALL
        SELECT c.key, c.row_no, c.leaf, CASE WHEN n.tree = {TOP} AND n.level = 0 THEN n.digest ELSE c.subroot END, concat(c.proof, {_SIBLINGS.format(path='n.path')}),
          {_FOLD.format(path='n.path', start='c.folded')}, n.up_tree, n.up_level, n.up_idx
        FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx {same_piece}
      )
      SELECT key, leaf, subroot, proof, folded FROM climb WHERE up_idx IS NULL
    """
    rows = spark.sql(query, leaves=manifest.leaves, nodes=nodes)
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, -1)  # the number of steps is bounded by the height of the trees
    try:
        return staged(rows, "climbed")
    finally:
        if limit is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, limit)
