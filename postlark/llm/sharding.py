"""Hierarchical weighted hash tree: documents to regions, racks and shards.

From the root down, each child of a node draws -ln(u) / weight, where u is a hash of
doc_id and the child's own name, and the smallest draw wins: a child gets rows in
proportion to its weight, the sum of its shards'. A draw depends on nothing but doc_id,
name and weight, so where a weight changes rows move only into or out of that child, and
only nodes above a changed shard have other weights. A child that comes anew takes rows
into itself alone, so growth() opens a region for its shard: no row moves elsewhere.

DataFrame functions only. Null ids are one id; rows of one id share a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, partitions, stored

#: Rows of a shard that are put in order by one task, about, and copies of a row that are one.
_BLOCK, _COPIES = 65_536, 10_000


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack; shards are numbered in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, shards: int, regions: int = 2, racks: int = 4) -> Tree:
        """Shards of weight 1 in regions of `racks` racks each, as even as they go."""
        deal = lambda n, k: [n // k + (i < n % k) for i in range(k)]
        return cls(tuple(tuple((1.0,) * r for r in deal(n, racks) if r) for n in deal(shards, regions) if n))

    def growth(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        return Tree((*self.weights, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def levels(self) -> list[list[list[tuple[int, float]]]]:
        """For each level the children of each node, as number and weight; a node is its place in the level above."""
        racks = [rack for region in self.weights for rack in region]
        flat = [[sum(map(sum, region)) for region in self.weights]], [[sum(rack) for rack in region] for region in self.weights], [list(rack) for rack in racks]
        out = []
        for level in flat:
            n, nodes = 0, []
            for children in level:
                nodes.append([(n + i, w) for i, w in enumerate(children)])
                n += len(children)
            out.append(nodes)
        return out


def _draw(key: Column, level: int, child: Column, weight: Column) -> Column:
    """An exponential draw with the weight as its rate, of 52 bits of a hash."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(level)), child.cast("string"))), 1, 13), 16, 10).cast("double")
    return -F.log((u + 0.5) / float(1 << 52)) / weight


def _drawing(key: Column, level: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(_draw(key, level, c["child"], c["weight"]).alias("draw"), c["child"].alias("child"))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: one descent, level by level. Children of weight 0 get nothing."""
    node = F.lit(0)
    for level, nodes in enumerate(tree.levels()):
        table = F.array(*(F.array(*(F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in children if w > 0)) for children in nodes))
        node = F.array_min(F.transform(F.element_at(table, node + 1), _drawing(key, level)))["child"]
    return node


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def assign(docs: DataFrame, tree: Tree, *, id_col: str = "doc_id") -> DataFrame:
    """docs with a column shard (underscores in front where that is taken); narrow, without a shuffle."""
    (name,) = fresh(docs.columns, "shard")
    return docs.withColumn(name, shard_of(_key(id_col), tree))


def layout(docs: DataFrame, tree: Tree, grown: Sequence[Tree] = (), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shards under other trees (grown0, ...), a row for each document.

    Slots number a shard's rows gapless from 0 by a hash of id, size and checksum. Equal
    rows are counted before a shuffle and numbered as one, in pieces; a shard is cut into
    blocks by ranges of the hash, each numbered by itself behind the sum of those before.
    Empty tables give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    pieces = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES))).alias("piece"))
    key = F.md5(F.concat_ws(":", _key("doc_id"), "size", "text_crc32", "piece"))
    others = [shard_of(_key("doc_id"), t).alias(f"grown{i}") for i, t in enumerate(grown)]
    copies = F.least(F.col("n") - F.col("piece") * _COPIES, F.lit(_COPIES)).alias("copies")
    held = stored(pieces.select("doc_id", "size", "text_crc32", copies, key.alias("key"), shard_of(_key("doc_id"), tree).alias("shard"), *others), "shards")

    n = held.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    blocks = max(partitions(docs.sparkSession), -(-n // (_BLOCK * max(tree.shards, 1))))
    block = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(blocks) / float(1 << 32)).cast("long")
    held = held.withColumn("block", block)
    sums = held.groupBy("shard", "block").agg(F.sum("copies").alias("_in"))
    before = F.sum("_in").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    placed = held.join(sums.select("shard", "block", F.coalesce(before, F.lit(0)).alias("_base")), ["shard", "block"])
    w = Window.partitionBy("shard", "block").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("copies").over(w), F.lit(0))
    numbered = placed.withColumn("_start", start).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_start") + F.col("_i")).alias("slot"), *(F.col(f"grown{i}").cast("int").alias(f"grown{i}") for i in range(len(grown))))
