"""Merkle dataset manifest: concatenated-level strings.

A record is hashed to a leaf. The leaves of a group, in order, are the first level of its tree: every
``ARITY`` consecutive nodes (the last run may be shorter, one node even) are hashed to one node of
the next level, until one is left, the group's subroot. The subroots, in the order of the groups' names, are
the leaves of one more tree, whose last node is the root.

Spark: the records of a group are numbered by a range partitioning (counts per partition and group, added up),
so a group of any size is many partitions. ``BLOCK`` consecutive nodes, aligned to their tree, become
one row that keeps each of its ``LEVELS`` levels as one hex string: a parent is the hash of
a fixed-width substring, the siblings of a node are the substrings that flank it in its run. The tops of
the blocks are the nodes of the next round, so rounds shrink by ``BLOCK`` and no task sees more than blocks.
On the way down each block gets the steps above it by a join and hands them to its members.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deadwire.llm.common import materialize

ARITY, LEVELS = 3, 5
BLOCK = ARITY ** LEVELS  # 243 nodes: a first level of 15,552 characters
WIDTH = 64  # characters of a digest
_NONE = "array<struct<left: binary, right: binary>>"


def digest(value: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a record's fields, one after the other."""
    return digest(F.concat(*(field(f) for f in fields)))


def _upto(n: Column) -> Column:
    """0, 1, ..., n - 1; nothing for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _parents(level: Column) -> Column:
    run = ARITY * WIDTH
    runs = F.ceil(F.octet_length(level) / F.lit(run))
    return F.encode(F.array_join(F.transform(_upto(runs), lambda i: F.sha2(
        F.substring(level, i * run + 1, F.lit(run)), 256)), ""), "utf-8")


def _steps(at: Column, levels: Column, height: Column) -> Column:
    """Siblings left and right of node ``at`` and its ancestors in a block, level by level."""
    widths = F.array(*(F.lit(ARITY ** j) for j in range(LEVELS)))

    def step(j: Column) -> Column:
        level = F.element_at(levels, j + 1)
        node = F.floor(at / F.element_at(widths, j + 1)).cast("int")
        place = node % ARITY
        return F.struct(
            F.substring(level, (node - place) * WIDTH + 1, place * WIDTH).alias("left"),
            F.substring(level, (node + 1) * WIDTH + 1, (ARITY - 1 - place) * WIDTH).alias("right"))

    return F.transform(_upto(height), step)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... by ``order`` inside ``group``) and ``n`` (rows of the group).

    One range partitioning by (group, order); each partition counts its own rows, and a table of one row per
    partition and group says how many stand before them. Equal rows of the order are told apart by
    their place in the written input, so a hot group or key is spread as well."""
    keys = [group, *order, "_place"]
    ranged = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(
        *(F.col(k).asc_nulls_first() for k in keys)).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys))
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_id", 33)).drop("_place"), name)
    parts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", "_first", F.sum("_rows").over(whole).alias("n"),
                         F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (ranged.join(parts, [group, "_part"])
            .withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first"))
            .drop("_before", "_id", "_first", "_part"))


def _rounds(nodes: DataFrame, payload: list[str], name: str) -> list[DataFrame]:
    """nodes(grp, pos, n, node, *payload) -> written tables of blocks, the last with one block per grp."""
    tables: list[DataFrame] = []
    while True:
        member = F.struct("pos", "node", *payload)
        blocks = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
        size = F.size("members")
        short = sum(((size > ARITY ** j).cast("int") for j in range(1, LEVELS)), (size > 1).cast("int"))
        blocks = blocks.withColumn("height", F.when(F.col("n") > BLOCK, LEVELS).otherwise(short))
        first = F.encode(F.array_join(F.transform("members", lambda m: m["node"]), ""), "utf-8")
        levels = F.aggregate(_upto(F.col("height")), F.array(first), lambda done, _: F.concat(
            done, F.array(_parents(F.element_at(done, -1)))))
        blocks = materialize(blocks.withColumn("levels", levels), name)
        tables.append(blocks)
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= BLOCK:
            return tables
        payload = []
        nodes = blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
                              _top().alias("node"))


def _top() -> Column:
    return F.decode(F.element_at("levels", -1), "utf-8")


def _members(blocks: DataFrame, carry: list[str]) -> DataFrame:
    """A row per node of ``blocks``: (grp, *carry, m: its member struct, steps up to the block's top)."""
    each = F.transform("members", lambda m, i: F.struct(m.alias("m"), _steps(i, F.col("levels"), F.col("height")).alias("own")))
    return blocks.select("grp", *carry, F.explode(each).alias("x")).select("grp", *carry, "x.m", "x.own")


def _descend(tables: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """above(grp, up, *carry): the steps over each tree -> (grp, *carry, m, up): those over each of its leaves."""
    keys = ["grp"]
    for level, blocks in enumerate(reversed(tables)):
        met = blocks.join(above, keys)
        met = _members(met, ["up", *carry]).withColumn("up", F.concat("own", "up")).drop("own")
        if level + 1 == len(tables):
            return met
        above = met.select("grp", F.col("m.pos").alias("block"), "up", *carry)
        keys = ["grp", "block"]
    raise ValueError("no tables")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(steps, start, lambda now, s: F.sha2(F.concat(s["left"], now.cast("binary"), s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(steps, F.lit("").cast("binary"), lambda now, s: F.concat(now, s["left"], s["right"])), 256)


def manifest(leaves: DataFrame, group: str, order: str, leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``steps`` (left and right siblings from the leaf to the root).

    Leaves of a group stand by ``order`` (nulls first), then by leaf; the groups by name (null first, bytewise).
    A null group is a group of its own; repeated rows are leaves of their own; a lone leaf is its group's
    subroot and a lone subroot the root, with no steps. Columns of other names are carried along. An empty
    table gives no rows. ``leaf_col`` may not be null."""
    own = {"subroot", "root", "steps"}
    rest = [c for c in leaves.columns if c not in own]
    # '' for the null group, '=' before every name: keeps the order and lets groups be joined on equality
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
                         F.col(order).alias("_order"), F.col(leaf_col).alias("node"), F.struct(*rest).alias("row"))
    nodes = numbered(materialize(rows, "leaves"), "grp", ["_order", "node"], "ordered-leaves").drop("_order")
    tables = _rounds(nodes, ["row"], "leaf-blocks")
    subroots = tables[-1].select(F.col("grp").alias("name"), _top().alias("node"), F.lit("").alias("grp"))
    tops = _rounds(numbered(subroots, "grp", ["name"], "subroots"), ["name"], "subroot-blocks")
    start = tops[-1].select("grp", F.array().cast(_NONE).alias("up"), _top().alias("root"))
    over = _descend(tops, start, ["root"]).select(F.col("m.name").alias("grp"), "up", F.col("m.node").alias("subroot"), "root")
    over = materialize(over, "subroot-steps")
    proofs = _descend(tables, over, ["subroot", "root"])
    return proofs.select("m.row.*", "subroot", "root", F.col("up").alias("steps"))
