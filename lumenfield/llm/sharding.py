"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row takes the child with the greatest weighted draw, ln(u) / weight, where the row's key and the child's name alone decide u.
A node's weight is the sum of its shards' weights. When weights change, a draw changes only at nodes on the way to the change, so rows move only
between the subtrees whose weights changed and others of the same level. Capacity that is added as a region of its own takes rows only into itself.

DataFrame functions only; the number of draws a row needs is the sum, not the product, of the fan-outs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.llm.tables import Workspace, unit_draw


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, *, per_rack: int = 2, racks: int = 4) -> list[Shard]:
    """Shards of equal weight in racks of ``per_rack`` and regions of ``racks`` racks."""
    return [Shard(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    return [*tree, Shard(1 + max((s.region for s in tree), default=-1), 0, 1 + max((s.shard for s in tree), default=-1), weight)]


def _draw(key: Column, path: Column, children: Column) -> Column:
    """The child with the greatest weighted draw; the least number on a tie. children: array of (c, w)."""
    drawn = F.transform(children, lambda x: F.struct((F.log(unit_draw(key, path, x["c"])) / x["w"]).alias("d"), (-x["c"]).alias("c")))
    return -F.array_max(drawn)["c"]


def _children(tree: list[Shard], child, *parent) -> Column:
    """Map from parent (its numbers joined by /) to its children with their weights."""
    weights: dict[str, dict[int, float]] = {}
    for s in tree:
        if s.weight > 0:
            inside = weights.setdefault("/".join(str(p(s)) for p in parent), {})
            inside[child(s)] = inside.get(child(s), 0.0) + s.weight
    cells = []
    for name, inside in sorted(weights.items()):
        cells += [F.lit(name), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in sorted(inside.items())])]
    return F.create_map(*cells)


def place(df: DataFrame, key: Column, tree: list[Shard], out: str) -> DataFrame:
    """Adds the column ``out``: the shard of each row. ``df`` must not have columns named region__, rack__. Shards of weight 0 get nothing."""
    region, rack, shard = (lambda s: s.region), (lambda s: s.rack), (lambda s: s.shard)
    df = df.withColumn("region__", _draw(key, F.lit("region"), _children(tree, region)[F.lit("")]))
    at = F.col("region__").cast("string")
    df = df.withColumn("rack__", _draw(key, F.concat_ws("/", F.lit("rack"), at), _children(tree, rack, region)[at]))
    at = F.concat_ws("/", "region__", "rack__")
    last = _draw(key, F.concat_ws("/", F.lit("shard"), at), _children(tree, shard, region, rack)[at])
    return df.withColumn(out, last.cast("int")).drop("region__", "rack__")


def slots(df: DataFrame, shard: str, order: list[str], parts: int) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 … without gaps in each shard. No shard is sorted in one task: rows are numbered within one of ``parts`` hash parts
    of their shard, and the sizes of the parts before it, a table of shards x parts rows, are added. ``df`` must not have part__, before__."""
    df = df.withColumn("part__", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = df.groupBy(shard, "part__").agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.partitionBy(shard).orderBy("part__")) - F.col("n__")
    offsets = sizes.select(F.col(shard), "part__", before.alias("before__"))
    number = F.row_number().over(Window.partitionBy(shard, "part__").orderBy(*order)) - 1
    return df.withColumn("number__", number).join(offsets, [shard, "part__"]).withColumn("slot", (F.col("number__") + F.col("before__")).cast("long")).drop("part__", "number__", "before__")


def shard_table(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", parts: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard (with one more shard).

    The law is ``key``: the id and the number of shards decide. A null id is a key of its own, null texts have size 16 and the CRC-32 of no bytes.
    Equal ids (and so repeated rows) share a shard and take one slot each. An empty table gives an empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    tree = layout(shards)
    out = place(place(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    # the draws are made once, not again for the sizes of the parts
    out = slots(Workspace(docs.sparkSession).save(out, "placed"), "shard", ["doc_id", "size", "text_crc32"], parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
