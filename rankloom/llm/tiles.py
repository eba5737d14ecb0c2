"""All pairs inside groups, by tiles of a bounded size, as spanning forests of the links found.

A group of rows is cut by a hash of their keys into tiles. Every tile, and every pair of tiles of one group, is a row of
work of its own, and these rows are dealt over all partitions by the pair's numbers; so a group with a third of all rows
is compared by all tasks. No list of pairs ever exists: a comparison emits links that connect what is connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, join_counted, materialize, partitions

#: (values of one or two tiles, size of the first) to links between their numbers.
Compare = Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]


def root(parent: dict[int, int], x: int) -> int:
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = parent[p]
        x = parent[x]
    return x


def dealt(rows: DataFrame, total: int, tiles: Column) -> DataFrame:
    """rows(grp, key, ...), a staged table, with tiles and tile, for the groups of more than one row. tiles: the number
    of tiles by aggregates over a group."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), tiles.cast("int").alias("tiles")).filter("n > 1")
    return join_counted(rows, sizes, "grp", total).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).drop("n")


def forests(members: DataFrame, compare: Compare, name: str) -> DataFrame:
    """(a, b): distinct links that connect the near members of each group of members(grp, tiles, tile, key, value)."""
    spark = members.sparkSession
    tiles = materialize(members.groupBy("grp", "tiles", "tile").agg(F.collect_list(F.struct("key", "value")).alias("m")), f"{name}-tiles")
    work = tiles.filter("tiles = 1").select(F.array("m").alias("sides"))
    shared = tiles.filter("tiles > 1")
    pairs = shared.select("grp", F.col("tiles").cast("long").alias("t")).distinct().agg(F.sum(F.col("t") * (F.col("t") + 1) / 2)).first()[0]
    if pairs:
        n = int(min(max(partitions(spark), pairs // 8), 100 * partitions(spark)))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        both = shared.select("grp", "tile", "m", other).select("grp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.struct("tile", "m").alias("s"))
        met = both.repartition(n, "grp", "i", "j").groupBy("grp", "i", "j").agg(F.sort_array(F.collect_list("s")).alias("s"))
        work = work.unionByName(met.select(F.col("s.m").alias("sides")))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = batch.column(0)
            for k in range(batch.num_rows):
                lists = sides[k].values
                members = lists.flatten()
                a, b = compare(members.field("value"), len(lists[0]))
                keys = members.field("key").to_numpy(zero_copy_only=False)
                low, high = np.minimum(keys[a], keys[b]), np.maximum(keys[a], keys[b])
                yield pa.record_batch([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])
        give_back()

    found = materialize(work.mapInArrow(links, "a long, b long").distinct(), f"{name}-links")
    discard(tiles)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps (root: the smallest node).

    Every step is a hash aggregation and an equi-join on nodes, hot nodes broadcast; each round is written to shared
    storage, and the round before it deleted."""
    star = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = materialize(star, "star")
    total, before = star.count(), None
    while True:
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both, low, "u", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, "u", total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = materialize(small, "star")
        discard(star, large)
        star = small
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        total = now[0]
        if tuple(now) == before and now[0] == now[2]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)


def named(classes: DataFrame, found: DataFrame, total: int, *figures: Column) -> DataFrame:
    """classes(key, ...) with root (its own key if it has no link) and figures, aggregates over its component."""
    rooted = classes.join(found.toDF("key", "root").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = materialize(rooted, "rooted")
    return join_counted(rooted, rooted.groupBy("root").agg(F.count("*").alias("n"), *figures), "root", total).drop("n")
