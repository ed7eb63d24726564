"""Merkle manifest of a table: hash trees whose runs of children are spread into columns.

Rows of one group (a source) are leaves in the order of their id. Sixteen consecutive nodes
are one run: conditional aggregates, one for each slot, spread its children into sixteen
columns of one row. Those columns, concatenated and hashed, are the parent; the same columns
without a child's own slot are that child's siblings. Levels go on until a group has one
node, its subroot. The subroots are leaves of a tree of their own, whose end is the root.

Leaves are numbered by a range-partitioned sort: the place of a row is its place in its
partition plus the rows of its group in earlier partitions, so a source with a third of all
rows is numbered and hashed by many tasks. Proofs go down the stored levels: a run takes the
path of its parent, and hands each child that path with the child's siblings before it. A
run meets one path, so no join has a hot key.

Defined results: a null value is `-`. Null sources are one group, the first one; null ids
come first in their group and are never tampered with. Equal ids lie in the order of their
hashes; repeated rows are leaves each. A lone row is its source's subroot, and a lone source's
subroot is the root; the proof of a tree of one leaf is the hash of nothing. An empty table
has no rows and no root. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stakelens.llm.scratch import stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 5
_SLOTS = [f"s{k}" for k in range(FANOUT)]
# The letters that tampering replaces.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of strings laid end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(text.isNull(), F.lit("-")).otherwise(sized)


def leaf(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """Hash of a row's fields; `changed` replaces some of them."""
    return digest(*[field(changed.get(name, F.col(f"`{name}`"))) for name in fields])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `pos`, the place of a row in its `tree` by `order`, and `size`, its tree's rows.

    `order` must tell all rows of a tree apart, unless they are equal in all columns.
    """
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # Stored, so that the numbers of rows stay as they are when a task runs again.
    placed = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    # A row for each tree and partition: as many as partitions and trees together.
    runs = placed.groupBy("tree", "part").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    tree = W.partitionBy("tree")
    starts = runs.select(
        "tree",
        "part",
        "first",
        (F.sum("rows").over(tree.orderBy("part")) - F.col("rows")).alias("start"),
        F.sum("rows").over(tree).alias("size"),
    )
    pos = F.col("at") - F.col("first") + F.col("start")
    return placed.join(starts, ["tree", "part"]).select(*rows.columns, pos.alias("pos"), "size")


def _runs(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """The runs of the trees with several nodes: tree, size, pos of the parent, slots, hash."""
    child = ", ".join(["hash", *carried])
    slots = [
        F.expr(f"max(struct({child})) FILTER (WHERE pos % {FANOUT} = {k})").alias(name)
        for k, name in enumerate(_SLOTS)
    ]
    return (
        nodes.filter("size > 1")
        .groupBy("tree", "size", F.expr(f"pos DIV {FANOUT}").alias("parent"))
        .agg(*slots)
        .withColumnRenamed("parent", "pos")
        .withColumn("hash", digest(F.expr(_joined(_SLOTS))))
    )


def _joined(slots: list[str]) -> str:
    """SQL of the hashes of the filled slots, from left to right."""
    return f"concat_ws({', '.join(["''", *[f'{name}.hash' for name in slots]])})"


def _child(k: int) -> str:
    """SQL of the child in slot k with its siblings; null if the slot is empty."""
    left, right = _joined(_SLOTS[:k]), _joined(_SLOTS[k + 1 :])
    side = f"named_struct('left', {left}, 'right', {right})"
    node = f"named_struct('slot', {k}, 'node', s{k}, 'side', {side})"
    return f"IF(s{k} IS NOT NULL, {node}, NULL)"


_CHILDREN = f"explode(array({', '.join(_child(k) for k in range(FANOUT))}))"


class Forest:
    """The stored levels of some trees, from their leaves up, and a root for each.

    `nodes` has tree, size, pos, hash and the columns to be carried with the leaves.
    """

    def __init__(self, nodes: DataFrame, carried: list[str]):
        self.carried = carried
        self.leaves = nodes
        self.levels: list[DataFrame] = []
        most = nodes.agg(F.max("size")).first()[0] or 0
        ends, own = [nodes.filter("size = 1").select("tree", "hash")], carried
        while most > 1:
            level = stored(_runs(nodes, own), "level")
            self.levels.append(level)
            above = F.ceil(F.col("size") / FANOUT)
            nodes = level.select("tree", above.alias("size"), "pos", "hash")
            ends.append(nodes.filter("size = 1").select("tree", "hash"))
            most, own = -(-most // FANOUT), []
        self.roots = ends[0]
        for end in ends[1:]:
            self.roots = self.roots.unionByName(end)

    def proofs(self, paths: DataFrame) -> DataFrame:
        """hash and carried columns of each leaf, with the columns of its tree's `paths` row.

        `paths` has tree, path and more. A path lists, upwards, what is left and right of a
        node in its run; the siblings of the leaf and of its ancestors come before it.
        """
        given = [c for c in paths.columns if c not in ("tree", "path")]
        above = None
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth].drop("hash")
            # The topmost run of a tree has its root as parent.
            found = level.filter(F.col("size") <= FANOUT).join(paths, "tree")
            if above is not None:
                lower = level.filter(F.col("size") > FANOUT).join(above, ["tree", "pos"])
                found = found.unionByName(lower.select(found.columns))
            children = F.expr(_CHILDREN).alias("c")
            found = found.select("tree", "pos", *given, "path", children).filter("c IS NOT NULL")
            longer = F.concat(F.array(F.col("c.side")), F.col("path")).alias("path")
            place = (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos")
            node = [F.col("c.node.hash")] if depth else [F.col("c.node.*")]
            above = found.select("tree", place, *given, longer, *node)
            if depth:
                above = above.drop("hash")
        names = ["hash", *self.carried, *given, "path"]
        lone = self.leaves.filter("size = 1").join(paths, "tree").select(names)
        return lone if above is None else lone.unionByName(above.select(names))


def siblings(path: Column) -> Column:
    """All siblings on a path, level by level."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to along a path."""
    return F.aggregate(path, start, lambda h, x: digest(x["left"], h, x["right"]))


def tampered_text() -> Column:
    """The text, its A-Z made lower case where 5 divides the CRC of the id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return F.when(chosen, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def manifest(docs: DataFrame, seen_text: Column | None = None) -> DataFrame:
    """A row for each document: its leaf, its source's subroot, the root and its proof.

    `seen_text` stands for the text that is checked against the manifest: the root is
    recomputed from it along the original siblings, and `verified` says if it is the same.
    """
    spark = docs.sparkSession
    found = F.col("leaf") if seen_text is None else leaf(text=seen_text)
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("1"), "source"))
    rows = docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("leaf"),
        *[F.col(c) for c in FIELDS if c != "doc_id"],
    ).select("tree", "doc_id", F.col("leaf").alias("hash"), found.alias("seen"))
    # Rows that share an id and a hash, even a third of all, still spread over the ranges.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(rows, ["doc_id", "hash", "seen", "row"]).drop("row")
    sources = Forest(leaves, ["doc_id", "seen"])
    tops = sources.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("of"), "hash")
    top = Forest(numbered(tops, ["of"]), ["of"])
    end = top.roots.first()
    if end is None:
        return spark.createDataFrame([], RESULT)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    paths = top.proofs(top.roots.select("tree", nothing.alias("path")))
    paths = stored(
        paths.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "path"), "paths"
    )
    root = F.lit(end["hash"])
    return sources.proofs(paths).select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        root.alias("root"),
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.col("seen"), F.col("path")).alias("folded_root"),
        (folded(F.col("seen"), F.col("path")) == root).alias("verified"),
    )
