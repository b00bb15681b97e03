"""Merkle manifest of a table: one tree per group, one over the groups, and every row's proof, by butterfly exchange.

Leaves are dealt to aligned blocks of FANOUT ** HEIGHT consecutive leaves of one group. A block hashes its own subtree;
from then on blocks work as the nodes of a butterfly network. In each round the blocks that stand at the same place of
the up to FANOUT subtrees below one parent swap those subtrees' roots, and each hashes the parent for itself. So after
a logarithmic number of rounds every block holds all siblings of its way up and the root, and nothing is sent down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import cut, stored

FANOUT = 16
HEIGHT = 3
BLOCK = FANOUT**HEIGHT

_PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value's UTF-8 byte count, a colon and the value; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number a partition's rows within each group; they come in order of groups."""
    group, nr = object(), 0
    for batch in batches:
        numbers = []
        for value in batch.column("grp"):
            value = value.as_py()
            if value != group:
                group, nr = value, 0
            numbers.append(nr)
            nr += 1
        yield batch.append_column("nr", pa.array(numbers, pa.int64()))


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with group_no, pos (from 0 within the group) and block; groups with group_no, grp, n and blocks.

    Rows are range-partitioned by group, id and hash and numbered in each partition; what is added up afterwards is one
    row for each partition and group. No group is sorted in one task.
    """
    ranged = leaves.repartitionByRange("grp", "id", "leaf", "changed").sortWithinPartitions("grp", "id", "leaf", "changed")
    numbered = stored(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_counted, "grp string, id long, leaf string, changed string, part int, nr long"), "leaves")
    pieces = cut(numbered.groupBy("part", "grp").agg(F.count("*").alias("rows")))
    # A group's number: groups that began in earlier partitions, then those that begin before it in its own.
    first = Window.partitionBy("grp").orderBy("part")
    pieces = pieces.withColumns({"before": F.coalesce(F.sum("rows").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "begins": (F.row_number().over(first) == 1).cast("long")})
    per_part = pieces.groupBy("part").agg(F.sum("begins").alias("begun"))
    per_part = per_part.withColumn("earlier", F.coalesce(F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("begun")
    in_part = Window.partitionBy("part").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("own", F.sum("begins").over(in_part)).join(per_part, "part")
    pieces = pieces.withColumn("group_no", F.col("earlier") + F.col("own") - 1).drop("begins", "own", "earlier")
    pieces = cut(pieces)
    groups = pieces.groupBy("group_no").agg(F.first("grp").alias("grp"), F.sum("rows").alias("n"))
    groups = groups.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    same = (numbered["part"] == pieces["part"]) & numbered["grp"].eqNullSafe(pieces["grp"])
    rows = numbered.join(pieces, same).select("group_no", numbered["grp"], "id", "leaf", "changed", (F.col("before") + F.col("nr")).alias("pos"))
    return rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")), groups


def _levels(count: Column) -> Column:
    """How often so many leaves of a block that is a whole group must be hashed together until one remains."""
    return F.when(count > FANOUT**2, 3).when(count > FANOUT, 2).when(count > 1, 1).otherwise(0)


def _folded(nodes: Column) -> Column:
    """The next level: the hash of every FANOUT consecutive nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")), lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _block_roots(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Units of the butterfly: group_no, block, blocks (of the group), levels (inside the block), root."""
    listed = rows.groupBy("group_no", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "leaf"))), lambda x: x["leaf"]).alias("nodes"))
    units = listed.join(groups.select("group_no", "blocks"), "group_no").withColumn("levels", F.when(F.col("blocks") > 1, HEIGHT).otherwise(_levels(F.size("nodes"))))
    for level in range(HEIGHT):
        units = units.withColumn("nodes", F.when(F.col("levels") > level, _folded(F.col("nodes"))).otherwise(F.col("nodes")))
    return units.select("group_no", "block", "blocks", "levels", F.get("nodes", F.lit(0)).alias("root"), F.array().cast(_PATH).alias("path"))


def _swap(units: DataFrame, tree: str) -> DataFrame:
    """One round of the butterfly in every tree.

    Takes node (the subtree's number on its level), rank (the unit's place in the subtree), size (units of the
    subtree) and width (units of the largest subtree below the same parent). A subtree with fewer units than its
    siblings has each unit stand in at several places, so no place lacks a root and no unit gets more than FANOUT rows
    in a place. Sends at most FANOUT times as many rows as there are units.
    """
    payload = [c for c in units.columns if c not in (tree, "node")]
    sent = units.select(
        tree, F.floor(F.col("node") / FANOUT).alias("parent"), F.col("node"), F.explode(F.sequence(F.col("rank"), F.col("width") - 1, F.col("size"))).alias("place"), F.col("root"),
        F.struct(*payload).alias("unit"),
    )
    sent = sent.withColumn("unit", F.when(F.col("place") == F.col("unit.rank"), F.col("unit")))
    met = sent.groupBy(tree, "parent", "place").agg(F.array_sort(F.collect_list(F.struct("node", "root", "unit"))).alias("members"))
    met = met.withColumn("roots", F.transform("members", lambda m: m["root"]))
    met = met.select(tree, "roots", digest(F.array_join("roots", "")).alias("above"), F.posexplode("members").alias("i", "m")).where("m.unit is not null")
    side = F.struct(F.array_join(F.slice("roots", 1, F.col("i")), "").alias("before"), F.array_join(F.slice("roots", F.col("i") + 2, FANOUT), "").alias("after"))
    kept = [F.col(f"m.unit.{c}").alias(c) for c in payload if c not in ("root", "path", "rank", "size", "width")]
    return met.select(tree, F.floor(F.col("m.node") / FANOUT).alias("node"), *kept, F.col("above").alias("root"), F.concat("m.unit.path", F.array(side)).alias("path"))


def _within_groups(units: DataFrame, most: int) -> DataFrame:
    """Rounds inside each group until its blocks know its root (subroot); most is the largest number of blocks of a group."""
    span, base = 1, units.columns
    while span < most:
        units = units.withColumns({"node": F.floor(F.col("block") / span), "rank": F.col("block") % span})
        size = F.least(F.lit(span), F.col("blocks") - F.col("node") * span)
        parent_start = F.floor(F.col("node") / FANOUT) * FANOUT * span
        units = units.withColumns({"size": size, "width": F.least(F.lit(span), F.col("blocks") - parent_start)})
        open_ = units.where(F.col("blocks") > span)
        units = _swap(open_, "group_no").select(base).unionByName(units.where(F.col("blocks") <= span).select(base))
        span *= FANOUT
    return units.withColumn("subroot", F.col("root"))


def _over_groups(units: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """Rounds over the groups, in which every block of every group takes part, until all know the root of all."""
    nodes = groups.select(F.col("group_no").alias("node"), F.col("blocks").alias("size"))
    units = units.withColumns({"tree": F.lit(0), "node": F.col("group_no"), "rank": F.col("block")})
    base = units.columns
    while count > 1:
        family = Window.partitionBy(F.floor(F.col("node") / FANOUT))
        ahead = F.coalesce(F.sum("size").over(family.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = cut(nodes.withColumns({"width": F.max("size").over(family), "ahead": ahead}))
        known = units.join(nodes, "node").withColumn("next_rank", F.col("ahead") + F.col("rank")).drop("ahead")
        units = _swap(known, "tree").withColumnRenamed("next_rank", "rank").select(base)
        nodes = nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sum("size").alias("size"))
        count = -(-count // FANOUT)
    return units.drop("tree", "node", "rank")


def _sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


_OUT = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _prove(rows: pa.Table, unit: pa.Table) -> pa.Table:
    """Every leaf's proof and the root that its changed leaf folds to, for the leaves of one block."""
    rows = rows.sort_by("pos")
    ids, leaves, changed = (rows.column(c).to_pylist() for c in ("id", "leaf", "changed"))
    top = {c: unit.column(c)[0].as_py() for c in ("levels", "subroot", "root", "path")}
    inner = [leaves]
    for _ in range(top["levels"]):
        inner.append([_sha(*inner[-1][i : i + FANOUT]) for i in range(0, len(inner[-1]), FANOUT)])
    # Per level and node of the block, what stands before and after it in its run.
    sides = []
    for nodes in inner[:-1]:
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        sides.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
    upper = [(p["before"], p["after"]) for p in top["path"]]
    tail = "".join(b + a for b, a in upper)
    proofs, folded = [], []
    for i, (old, new) in enumerate(zip(leaves, changed)):
        way, at = [], i
        for level in sides:
            way.append(level[at])
            at //= FANOUT
        proofs.append(_sha(*(b + a for b, a in way), tail))
        value = new
        for before, after in [*way, *upper]:
            value = _sha(before, value, after)
        folded.append(value)
    same = lambda c: pa.array([top[c]] * len(ids), pa.string())
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves), same("subroot"), same("root"), pa.array(proofs), pa.array(folded)], schema=_OUT)


def manifest(rows: DataFrame, group_col: str, id_col: str, leaf: Column, changed: Column) -> DataFrame:
    """Each row's leaf, its group's subroot, the root, the digest of its proof and what its changed leaf folds to.

    leaf and changed are hex digests made from a row; changed is that of the row as it is found later. Leaves ascend by
    id within a group, null ids first; of equal ids (repeated rows) by leaf, then by changed leaf, so equal rows are
    leaves side by side. Groups ascend bytewise, null first, and the empty text is a group of its own. A lone leaf is
    its group's subroot, a lone subroot the root; then the proof has no siblings and its digest is that of no bytes.
    Returns id, leaf, subroot, root, proof_sha256, folded_root, verified (folded_root equals root), one row for each
    row. No rows give no rows. Other columns are ignored.

    The driver sees two numbers, the blocks of the largest group and the number of groups. A block's rows (at most
    FANOUT ** HEIGHT of some 200 bytes) are the most that one task has to hold.
    """
    leaves = stored(rows.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), changed.alias("changed")), "hashes")
    placed, groups = _placed(leaves)
    groups = cut(groups)
    most, count = groups.agg(F.max("blocks"), F.count("*")).first()
    units = _within_groups(_block_roots(placed, groups), most or 0)
    units = cut(_over_groups(units, groups, count).select(F.col("group_no").alias("unit_group"), F.col("block").alias("unit_block"), "levels", "subroot", "root", "path"))
    shape = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proved = placed.drop("grp").groupBy("group_no", "block").cogroup(units.groupBy("unit_group", "unit_block")).applyInArrow(_prove, shape)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaf(text: Column) -> Column:
    """The leaf of a row of documents with this text."""
    return digest(F.concat(*[encoded(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]))


def document_manifest(documents: DataFrame) -> DataFrame:
    """Manifest of documents by source, held against documents in which rows with crc32(doc_id) divisible by 5 have A-Z of their text in lower case.

    Nulls in any column are leaves' hyphens; a row without doc_id isn't changed. Returns doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified; see manifest for ties, repeated rows and empty tables.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    own = document_leaf(F.col("text"))
    changed = F.when(hit & F.col("text").rlike("[A-Z]"), document_leaf(lower_ascii(F.col("text")))).otherwise(own)
    found = manifest(documents.select("doc_id", "source", "lang", "n_chars", "text"), "source", "doc_id", own, changed)
    return found.withColumnRenamed("id", "doc_id")
