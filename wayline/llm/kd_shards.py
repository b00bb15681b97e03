"""Sharding by a k-d tree over document metadata.

Groups of equal texts are the points. A node of the tree with several shards to give is split along its widest dimension
at the weighted median (for an odd number of shards at the share of one half of them), by bytes, until each leaf is one
shard of the target size. Few groups of a sizeable part of a shard are placed beforehand, and leaves get what room they
leave. All nodes of a level are split at once; medians come from distributed histograms that are refined digit by digit,
so the driver sees at most NODES * BINS sums at a time, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import cut, stored

BINS = 1 << 10
DIGITS = 6
"""Keys have DIGITS digits of 10 bits: three for the place along the dimension, three to part ties by text hash."""

SLOT_ROWS = 1 << 16


def _literal_map(values: dict, kind: str, default):
    """A CASE over node numbers."""
    out = F.lit(default).cast(kind)
    for node, value in values.items():
        out = F.when(F.col("node") == node, F.lit(value).cast(kind)).otherwise(out)
    return out


def _points(documents: DataFrame) -> DataFrame:
    """One row per group of equal texts: its key, bytes and metadata dimensions scaled to [0, 1)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"),
        F.col("text").isNull().alias("none"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("row"),
    )
    return rows


def _split_keys(groups: DataFrame, dims: dict[int, str]) -> DataFrame:
    """Adds key: the order of groups along their node's dimension, ties by text hash."""
    place = F.lit(0.0)
    for node, dim in dims.items():
        place = F.when(F.col("node") == node, F.col(dim)).otherwise(place)
    high = (F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)) * F.lit((1 << 30) - 1)).cast("long")
    return groups.withColumn("key", F.shiftleft(high, 30) + F.col("tie"))


def _medians(keyed: DataFrame, goals: dict[int, float]) -> dict[int, int]:
    """For each node the key up to which groups go left, so that their bytes come nearest to the goal (a part of the node's)."""
    totals = {r["node"]: r["w"] for r in keyed.groupBy("node").agg(F.sum("bytes").alias("w")).collect()}
    goal = {node: totals.get(node, 0) * part for node, part in goals.items()}
    prefix, below, chosen = dict.fromkeys(goals, 0), dict.fromkeys(goals, 0), {}
    for digit in range(DIGITS):
        shift = 10 * (DIGITS - 1 - digit)
        open_ = [n for n in goals if n not in chosen]
        if not open_:
            break
        rows = (
            keyed.where(F.col("node").isin(open_))
            .where(F.shiftright("key", shift + 10) == _literal_map({n: prefix[n] for n in open_}, "long", -1))
            .groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("bytes").alias("w"), F.count("*").alias("c")).collect()
        )
        bins: dict[int, list] = {n: [] for n in open_}
        for r in rows:
            bins[r["node"]].append((r["bin"], r["w"], r["c"]))
        for node in open_:
            before = below[node]
            chosen[node] = -1  # stands if the node is empty
            for key, w, c in sorted(bins[node]):
                if before + w < goal[node]:
                    before += w
                    continue
                prefix[node], below[node] = key, before
                if c == 1 or digit == DIGITS - 1:
                    with_it = (before + w - goal[node]) <= (goal[node] - before)
                    chosen[node] = ((key + with_it) << shift) - 1
                else:
                    del chosen[node]
                break
    return chosen


def _big_groups(groups: DataFrame, key: list[str], total: int, shards: int) -> tuple[list, list[float]]:
    """Groups of over a 64th of a fair share with their shards, and the bytes that each shard may take besides.

    There are at most 64 * shards such groups, so they are placed one by one, the largest first, into the shard with
    the most room. A group of more than a fair share has its shard alone, and the others share the rest.
    """
    rows = groups.where(F.col("bytes") * 64 * shards >= total).orderBy(F.desc("bytes"), *key).limit(64 * shards).collect()
    placed, left = [], shards
    while rows and left > 1 and rows[0]["bytes"] * left >= total:
        big = rows.pop(0)
        left -= 1
        placed.append((big, left))
        total -= big["bytes"]
    room = [total / left] * left + [0.0] * (shards - left)
    for big in rows:
        shard = max(range(left), key=lambda i: room[i])
        placed.append((big, shard))
        room[shard] -= big["bytes"]
    return placed, [max(0.0, r) for r in room]


def kd_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (0 for null) plus 8; shards have nearly equal bytes (law is 'bytes'), and equal
    texts, null ones among them, share a shard. A group of more bytes than a fair share gets a shard of its own, and the
    rest is dealt to the others. slot counts a shard's documents from 0 without gaps, in an order that depends on
    where the table has the rows. Null ids, lang and source are allowed, repeated rows are counted each; other columns are ignored. An
    empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = stored(_points(documents), "points")
    key = ["h1", "crc", "size", "none"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)) / F.lit(float(1 << 20))
    groups = cut(
        groups.select(
            *key, "bytes", F.pmod(F.xxhash64("h1", "crc"), F.lit(1 << 30)).alias("tie"), unit("lang").alias("by_lang"), unit("source").alias("by_source"),
            (F.log2(F.col("size").cast("double")) / 40).alias("by_size"), F.coalesce(F.col("first_id"), F.lit(0)).cast("double").alias("by_id"),
        )
    )
    span = groups.agg(F.min("by_id").alias("a"), F.max("by_id").alias("b"), F.sum("bytes").alias("w")).first()
    if span["w"] is None:
        return rows.select(*_columns(F.lit(0), F.lit(0).cast("long")))
    groups = groups.withColumn("by_id", (F.col("by_id") - span["a"]) / max(1.0, span["b"] - span["a"]))

    big, room = _big_groups(groups, key, span["w"], shards)
    kinds = ", ".join(f"{k} {dict(groups.dtypes)[k]}" for k in key) + ", fixed int"
    fixed = spark.createDataFrame([(*(r[k] for k in key), shard) for r, shard in big], kinds)
    tree = cut(groups.join(F.broadcast(fixed), key, "left_anti").withColumn("node", F.lit(1)))

    # node -> the shards it holds, from first to last.
    level, leaves = {1: (0, max(i for i in range(shards) if room[i] > 0 or i == 0))}, {}
    names = ["by_lang", "by_source", "by_size", "by_id"]
    while level:
        leaves.update({node: a for node, (a, b) in level.items() if a == b})
        level = {node: (a, b) for node, (a, b) in level.items() if a < b}
        if not level:
            break
        inner = tree.where(F.col("node").isin(list(level)))
        widths = inner.groupBy("node").agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).collect()
        dims = {r["node"]: max(names, key=lambda c, r=r: r[c]) for r in widths}
        halves = {node: (a + b - 1) // 2 for node, (a, b) in level.items()}
        goals = {node: sum(room[a : halves[node] + 1]) / (sum(room[a : b + 1]) or 1.0) for node, (a, b) in level.items()}
        limits = _medians(_split_keys(inner, dims), goals)
        moved = _split_keys(tree, dims)
        right = (F.col("key") > _literal_map(limits, "long", -1)).cast("int")
        tree = cut(moved.withColumn("node", F.when(F.col("node").isin(list(level)), F.col("node") * 2 + right).otherwise(F.col("node"))).drop("key"))
        level = {2 * node + side: ((a, halves[node]), (halves[node] + 1, b))[side] for node, (a, b) in level.items() for side in (0, 1)}
    placed = tree.select(*key, _literal_map(leaves, "int", 0).alias("shard")).unionByName(fixed.withColumnRenamed("fixed", "shard"))
    dealt = rows.join(cut(placed), key)

    # Slots: counts per shard and chunk give offsets, so no task orders a whole shard.
    chunks = max(1, rows.count() // (shards * SLOT_ROWS) + 1) * 4
    # Dealt by row number: rows that repeat an id and a text, or have no id, spread over chunks as well.
    dealt = cut(dealt.select("doc_id", "size", "crc", "none", "shard", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")))
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("c"))
    offsets = counts.withColumn("base", F.sum("c").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("shard", "chunk", F.coalesce("base", F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "crc", "size", "none")) - 1
    out = dealt.withColumn("place", place).join(offsets, ["shard", "chunk"])
    return out.select(*_columns(F.col("shard"), F.col("base") + F.col("place")))


def _columns(shard, slot) -> list:
    return [
        F.col("doc_id"), F.col("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ]
