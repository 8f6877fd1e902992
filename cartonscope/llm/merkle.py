"""Merkle manifest of a table: a root over all rows and a proof for each row.

Every row is a leaf. Within a group (here: the language) leaves stand in ascending order and every two neighbours become their
hash, level by level, until one node is left, the group's subroot; a run of one node is hashed alone. Subroots, in order of their
groups, become the root in the same way.

Nodes are kept as concatenated levels: an aligned block of BLOCK nodes is one row that holds a level as one string of hex digests,
64 characters a node. Parents are hashes of fixed-width substrings of it, 128 characters wide, and the substrings beside a node's
path are its siblings. The nodes that blocks leave are the nodes of a next, BLOCK times smaller round. No task ever holds
more than a block, however many rows a group has.

Defined cases: a null group is a group of its own, first; a null id stands first in its group; rows of equal order stand in the order
of their leaf digests, so that equal rows are interchangeable and each is a leaf; an empty table gives an empty manifest.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartonscope.llm.common import stored

#: Nodes of a block, a power of two.
BLOCK = 512
DIGEST = 64


def field(value: Column) -> Column:
    """`-` if null, else the length in UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `pos`, the place within the group from 0, and `n`, the group's rows. Sorted over all tasks, no group in one of them.

    Rows are numbered within the part of their group that lies in one range of the sort; ranges of a group are then summed up.
    """
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows that tie in everything are interchangeable; the row number lets them fill several ranges.
    ranged = (rows.withColumn("row_at", F.monotonically_increasing_id())
              .repartitionByRange(shuffles, F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "row_at")
              .withColumn("part", F.spark_partition_id()).drop("row_at"))
    ranged = stored(ranged, "merkle-ranges")
    parts = ranged.groupBy("part", group).agg(F.count(F.lit(1)).alias("size"))
    along = Window.partitionBy(group).orderBy("part")
    before = F.coalesce(F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("part_"), F.col(group).alias("group_"), before.alias("before"),
                         F.sum("size").over(Window.partitionBy(group)).alias("n"))
    number = F.row_number().over(Window.partitionBy("part", group).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return (ranged.withColumn("number", number)
            .join(parts, (F.col("part") == F.col("part_")) & F.col(group).eqNullSafe(F.col("group_")))
            .withColumn("pos", F.col("before") + F.col("number") - 1)
            .drop("part", "part_", "group_", "before", "number"))


def _node(level: Column, at: Column) -> Column:
    """Digest number `at` of a level, empty beyond its end. Levels are bytes, so that a substring is found without a walk."""
    return F.substring(level, at * DIGEST + 1, F.lit(DIGEST))


def _parents(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (2 * DIGEST)).cast("int") - 1)
    return F.array_join(F.transform(pairs, lambda i: F.sha2(F.substring(level, i * 2 * DIGEST + 1, F.lit(2 * DIGEST)), 256)), "").cast("binary")


def _climbed(nodes: DataFrame, keys: list[str], block: int, payload: list[str]) -> DataFrame:
    """Blocks of nodes (keys, pos, n, node): keys, at (number of the block), of (the group's blocks), levels, members.

    levels: the block's nodes, their parents and so on, each level one string as bytes; its last is the node that the block leaves.
    A group of one block stops at one node; of several, every block climbs as far as a full one does.
    """
    height = block.bit_length() - 1
    member = F.struct("pos", "node", *payload)
    blocks = (nodes.groupBy(*keys, F.floor(F.col("pos") / block).alias("at"))
              .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members")))
    level = F.array_join(F.col("members.node"), "").cast("binary")
    blocks = blocks.withColumn("levels", F.array(level)).withColumn("of", F.ceil(F.col("n") / block))
    for _ in range(height):
        top = F.element_at("levels", -1)
        more = (F.col("of") > 1) | (F.octet_length(top) > DIGEST)
        blocks = blocks.withColumn("levels", F.when(more, F.concat("levels", F.array(_parents(top)))).otherwise(F.col("levels")))
    return blocks


def _siblings(levels: Column, inside: Column) -> Column:
    """What stands left and right of the path of node number `inside`, level by level, in all levels below the last."""
    def beside(k: Column) -> Column:
        at, level = F.call_function("shiftright", inside, k), F.element_at(levels, k + 1)
        left = at % 2 == 1
        other = _node(level, F.when(left, at - 1).otherwise(at + 1)).cast("string")
        return F.struct(F.when(left, other).otherwise(F.lit("")).alias("left"), F.when(left, F.lit("")).otherwise(other).alias("right"))
    steps = F.size(levels) - 1
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), beside)).otherwise(_no_path())


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def rounds(nodes: DataFrame, keys: list[str], block: int = BLOCK, payload: Sequence[str] = ()) -> list[DataFrame]:
    """Stored blocks of nodes (keys, pos, n, node, payload), then blocks of the nodes that those leave, until every group has one."""
    found = []
    while True:
        found.append(stored(_climbed(nodes, keys, block, list(payload) if not found else []), "merkle-blocks"))
        nodes = found[-1].filter("of > 1").select(*keys, F.col("at").alias("pos"), F.col("of").alias("n"), _top().alias("node"))
        if nodes.isEmpty():
            return found


def _top() -> Column:
    return F.element_at("levels", -1).cast("string")


def tops(found: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys and node: what is left of each group after all rounds."""
    last = [blocks.filter("of = 1").select(*keys, _top().alias("node")) for blocks in found]
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


def with_paths(found: list[DataFrame], keys: list[str], ends: DataFrame, given: Sequence[str] = ()) -> DataFrame:
    """The nodes that went into the first of found, with `path`: siblings up to the top of their group and on along its own path in ends.

    ends: keys, path and the columns `given` of each group, which its nodes take over. Paths are spread from the last round down, a
    join of blocks each time; nodes themselves are only taken out of their block at the end.
    """
    other = lambda df, names: df.select(*[F.col(c).alias(f"{c}_") for c in names], F.col("path").alias("above"), *given)
    same = lambda names: [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names]
    higher = None
    for blocks in reversed(found):
        placed_blocks = blocks.filter("of = 1").join(other(ends, keys), same(keys)) if higher is not None else blocks.join(other(ends, keys), same(keys))
        placed_blocks = placed_blocks.select(*blocks.columns, "above", *given)
        if higher is not None:
            inner = blocks.filter("of > 1").withColumnRenamed("at", "pos").join(other(higher, [*keys, "pos"]), same([*keys, "pos"]))
            placed_blocks = placed_blocks.unionByName(inner.withColumnRenamed("pos", "at").select(*blocks.columns, "above", *given))
        levels = F.col("levels")
        # The path is found inside the block's row; taking members out first would copy all levels for each.
        each = F.transform("members", lambda m, i: F.struct(m.alias("m"), _siblings(levels, i).alias("inner")))
        higher = placed_blocks.select(*keys, "above", *given, F.explode(each).alias("e")).select(
            *keys, *given, "e.m.*", F.concat("e.inner", "above").alias("path"))
    return higher


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang",
             order_col: str = "doc_id", keep: Sequence[Column] = (), block: int = BLOCK) -> DataFrame:
    """group, key (order_col), kept0, kept1, ... (the columns of keep), leaf, subroot, root, and path: the siblings from leaf to
    root, each left or right of the node. `folded(leaf, path)` gives the root if nothing was tampered with."""
    kept = [c.alias(f"kept{i}") for i, c in enumerate(keep)]
    names = ["key", *[f"kept{i}" for i in range(len(kept))]]
    leaves = stored(docs.select(F.col(group_col).cast("string").alias("group"), F.col(order_col).alias("key"),
                                leaf([F.col(c) for c in columns]).alias("node"), *kept), "merkle-leaves")
    of_rows = rounds(placed(leaves, "group", "key", "node"), ["group"], block, names)
    subroots = tops(of_rows, ["group"]).withColumn("all", F.lit(0))
    of_groups = rounds(placed(subroots, "all", "group"), ["all"], block, ["group"])
    root = tops(of_groups, ["all"]).select("all", F.col("node").alias("root"), _no_path().alias("path"))
    ends = with_paths(of_groups, ["all"], root, ["root"]).select("group", F.col("node").alias("subroot"), "root", "path")
    found = with_paths(of_rows, ["group"], ends, ["subroot", "root"])
    return found.select("group", *names, F.col("node").alias("leaf"), "subroot", "root", "path")


def folded(node: Column, path: Column) -> Column:
    """The top that a node and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path one after another."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
