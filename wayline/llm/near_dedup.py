"""Near-duplicate groups by bottom-k sketches from one hash function.

A document's word shingles are hashed once; the k smallest hashes are its sketch. Inverted lists over retained values
propose pairs, the sketch of the pair's union estimates their similarity, and full sets confirm it.

Two sets of similarity s share about s*k of the k smallest values of their union, and all of these are in both
sketches. Pairs with fewer than a bound six standard deviations below that are not proposed (chance of losing a link:
below 1e-8). Sets that share at least t of their k values have a value in common among the k - t + 1 that come first in
any fixed order. The order used is rarest first, by counts over the whole corpus, so that values of passages which many
documents share are hardly ever listed. Lists hold the LISTED smallest values; estimates use all SKETCH of them.

Where many documents are near copies of one text, and yet many pairs of them are just under the threshold, their lists
are long whatever the order. Such members are written as differences from one member of their list, the pivot: the
symmetric difference of two sets is that of their differences from the pivot, and what all of them share cancels out.
Members that aren't linked to the pivot must share more than half of the other's difference, which their own edits
leave no room for, so hardly a pair is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import cut, shingle_set, slices, stored
from wayline.llm.components import connected_components

SKETCH, LISTED = 48, 32
BUCKETS = 1 << 20
HOT_LIST = 32
WORDS = 8
BLOCK = 256
NEAR = 60  # per cent of its size that a set's difference from a pivot may have to be surely written as one


def least_shared(k: int, percent: int) -> int:
    """Fewest of the k smallest union values that a pair at the threshold shares, but for a chance below 1e-8."""
    p = percent / 100
    return max(1, math.ceil(p * k - 6 * math.sqrt(p * (1 - p) * k)))


def _digest(values: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that identify a set of hashes."""
    v = values.view(np.uint64)
    with np.errstate(over="ignore"):
        one, two = v.sum(dtype=np.uint64), ((v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _parities(values: np.ndarray) -> np.ndarray:
    """WORDS * 64 bits, each the parity of the number of values that fall to it.

    Where two sets' bits differ, one set has a value that the other lacks, and no value accounts for two such bits.
    """
    odd = np.bincount((values >> 9) & (WORDS * 64 - 1), minlength=WORDS * 64).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * WORDS
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            sizes, ones, twos, kept, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text, width)
                one, two = _digest(values)
                sizes.append(len(values))
                ones.append(one)
                twos.append(two)
                kept.append(values[:k])
                bits.append(_parities(values))
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            flat = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64), pa.int64())
            longs = [pa.array(c, pa.int64()) for c in (sizes, ones, twos)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), *longs, pa.ListArray.from_arrays(pa.array(ends), flat), _lists(bits)],
                ["id", "key", "n", "one", "two", "sketch", "bits"],
            )
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


def _repeated_values(width: int):
    """Rows (v, times): values that several of some texts that are read together have, and how many of these do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            values, times = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_counts=True)
            columns = (c[times > 1] for c in (values, times))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["v", "times"])

    return run


def _rare_parts(width: int, percent: int, common: np.ndarray):
    """Rows (v, uid, n, place): of each set so many values that two at the threshold share one of them.

    Sets of n and more values that share percent of their union share percent of n, so they have a value in common
    among the first n - percent of n + 1 that each has in any fixed order. The order is that of the hashes, but the
    common values, least common ones first, come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_value = np.argsort(common)
        for batch in (part for b in batches for part in slices(b, "text")):
            parts, uids, sizes, places = [], [], [], []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                values = shingle_set(text, width)
                late = np.zeros(len(values), np.int64)
                if len(common):
                    at = by_value[np.minimum(np.searchsorted(common, values, sorter=by_value), len(common) - 1)]
                    late = np.where(common[at] == values, at + 1, 0)
                n = len(values)
                first = n - (percent * n + 99) // 100 + 1
                parts.append(values[np.argsort(late, kind="stable")[:first]])
                uids.append(np.full(first, uid, np.int64))
                sizes.append(np.full(first, n, np.int64))
                places.append(np.arange(1, first + 1))
            columns = (np.concatenate([*c, np.empty(0, np.int64)]) for c in (parts, uids, sizes, places))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["v", "uid", "n", "place"])

    return run


def _with_hubs(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch of rows sorted by (hub, salt, role, uid): the members' (hub, uid, set of the hub, own set).

    A repeated row, or one whose text isn't that of its class, is passed over. One hub's set is held at a time.
    """
    hub, hub_set, last = None, None, None
    for batch in (part for b in batches for part in slices(b, "text")):
        out = []
        columns = [batch.column(c).to_pylist() for c in ("hub", "uid", "role", "one", "two", "text")]
        for at, uid, role, one, two, text in zip(*columns):
            if (role == 0 and at == hub) or (role and (at != hub or (at, uid) == last)):
                continue
            values = shingle_set(text, width)
            if _digest(values) != (one, two):
                continue
            if role == 0:
                hub, hub_set = at, values
            else:
                last = (at, uid)
                out.append((at, uid, hub_set, values))
        yield out


def _confirm(width: int, percent: int):
    """The members whose full sets are similar enough to their hub's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _with_hubs(width, batches):
            good = []
            for hub, uid, left, right in rows:
                at = np.searchsorted(left, right)
                shared = int((left[np.minimum(at, len(left) - 1)] == right).sum())
                if shared and 100 * shared >= percent * (len(left) + len(right) - shared):
                    good.append((min(hub, uid), max(hub, uid)))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _differences(width: int, percent: int):
    """Rows (pivot, uid, n, difference, linked) of members near their pivot, and rows without a difference for those far from it.

    Linked sets differ by at most (n + n') * (100 - percent) / (100 + percent). So if one of two linked members differs
    from the pivot by at most NEAR per cent of its size, the other does by at most (NEAR + 100 - percent) / percent of
    its own: both are near, or both are over NEAR per cent and far. A member between the bounds is both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _with_hubs(width, batches):
            out = []
            for hub, uid, left, right in rows:
                apart, n = np.setxor1d(left, right, assume_unique=True), len(right)
                if percent * len(apart) <= (NEAR + 100 - percent) * n:
                    total = len(left) + n
                    out.append((hub, uid, n, apart, (100 + percent) * len(apart) <= (100 - percent) * total))
                if 100 * len(apart) > NEAR * n:
                    out.append((None, uid, n, None, False))
            longs = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            rest = [pa.array([r[3] for r in out], pa.list_(pa.int64())), pa.array([r[4] for r in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*longs, *rest], ["pivot", "uid", "n", "difference", "linked"])

    return run


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    id that links reach, and kept marks that document. A null or word-free text has an empty set and is linked with
    nothing. A null id is never a component_id where another id is there; documents reached by null ids only have a
    null component_id and are all kept. Repeated rows are all returned, with the same component. Other columns are
    ignored, whatever their names; an empty table gives no rows.

    Equal sets are one class from the start. Lists are first joined as stars: each member is held against one other that
    stands for the list. Members whose components differ then are held against each other. In lists longer than HOT_LIST
    these are listed again: members near the list's pivot by the rarest part of their difference from it, by counts among
    themselves, the others by the part of their full sets that comes first if common values come last. A large group of
    copies costs a number of pairs in proportion to its size.
    """
    sketched, members = _components(documents, id_col, text_col, width, percent)
    smallest = members.groupBy("root").agg(F.min("rep.id").alias("component_id"))
    named = members.join(smallest, "root").select("one", "two", "component_id")
    filled = sketched.where("n > 0").select("id", "n", "one", "two").join(named, ["one", "two"])
    empty = sketched.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return filled.select("id", "n", "component_id").unionByName(empty).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one row of each group of near-duplicates.

    It is the row with the smallest id, one with a null id only if the group has no other; of its rows that repeat both
    id and text one stays. A document with an empty set has no near-duplicates and stays.
    """
    sketched, members = _components(documents, id_col, text_col, width, percent)
    best = cut(members.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias("kept_id"), F.col("rep.key").alias("kept_key")))
    own, key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    chosen = lambda kept: own.eqNullSafe(F.col("kept_id")) & (key == F.col("kept_key"))
    empty = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    alike = sketched.where("n > 0").groupBy("id", "key").count().where("count > 1")
    twice = cut(best.join(alike, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi"))
    once = best.join(twice.select(F.col("kept_id").alias("i"), F.col("kept_key").alias("k")), F.col("kept_id").eqNullSafe(F.col("i")) & (F.col("kept_key") == F.col("k")), "left_anti")
    stay = documents.where(~empty).join(once, chosen(once), "left_semi").unionByName(documents.where(empty))
    if twice.isEmpty():
        return stay
    return stay.unionByName(documents.where(~empty).join(twice, chosen(twice), "left_semi").dropDuplicates([id_col, text_col]))


def _components(documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched documents (id, key, n, one, two, ...) and their classes (one, two, rep, root); key is a hash of the text."""
    text = F.col(text_col)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    sketched = stored(
        docs.mapInArrow(_sketches(width, SKETCH), "id long, key long, n long, one long, two long, sketch array<long>, bits array<long>"), "sketches"
    )
    repeated = sketched.where("n > 0").groupBy("id", "key").count().where("count > 1")
    repeats = not repeated.isEmpty()
    # The document that stands for a class is told by id and text: ids may be null or repeated.
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    classes = stored(
        sketched.where("n > 0").groupBy("one", "two").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "classes",
    )

    def with_texts(tasks: DataFrame) -> DataFrame:
        """The tasks (with a column uid) and the digest and text of their class; only texts whose hash falls into a wanted bucket are shuffled."""
        wanted = cut(tasks.join(classes.select("uid", "one", "two", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key")), "uid"))
        bucket = lambda c: F.pmod(c, F.lit(BUCKETS))
        # At most BUCKETS rows are broadcast, whatever the corpus.
        near = F.broadcast(wanted.select(bucket("rep_key").alias("bucket")).distinct())
        some = docs.withColumn("bucket", bucket(F.col("key"))).join(near, "bucket", "left_semi")

        def met(rows: DataFrame, tasks_: DataFrame) -> DataFrame:
            same = rows["id"].eqNullSafe(F.col("rep_id")) & (rows["key"] == F.col("rep_key"))
            return rows.join(tasks_, same).select(*tasks.columns, "one", "two", "text")

        if not repeats:
            return met(some, wanted)
        # Rows that share id and text are made one before their text goes to each of its tasks; others travel as they are.
        own = (F.xxhash64("rep_id", "rep_key"), F.xxhash64("id", "key"))
        many = repeated.select(F.xxhash64("id", "key").alias("doc"))
        of_many = wanted.withColumn("doc", own[0]).join(many, "doc", "left_semi").drop("doc")
        of_one = wanted.withColumn("doc", own[0]).join(many, "doc", "left_anti").drop("doc")
        once = some.withColumn("doc", own[1]).join(many, "doc", "left_semi").groupBy("id", "key").agg(F.first("text").alias("text"))
        return met(some, of_one).unionByName(met(once, of_many))

    def in_blocks(pairs: DataFrame) -> DataFrame:
        """Texts of the pairs (hub, uid) in blocks of about BLOCK members, each led by the hub's text."""
        sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = cut(pairs.join(sizes, "hub").select("hub", "uid", F.pmod(F.xxhash64("uid"), F.col("blocks")).alias("salt")))
        hubs = dealt.select("hub", F.col("hub").alias("uid"), "salt").distinct().withColumn("role", F.lit(0))
        rows = with_texts(dealt.withColumn("role", F.lit(1)).unionByName(hubs))
        return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "uid")

    def apart() -> str:
        """The number of set parities that differ, at most that of values that one set has and the other lacks."""
        return " + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(WORDS))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (hub, uid) of classes those that are links, as (a, b): estimated by union sketches, then by full sets."""
        # Half of each value is enough to estimate with.
        sketches = classes.select("uid", "n", "bits", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("sketch"))
        side = lambda x, name: sketches.select(F.col("uid").alias(name), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "sketch")])
        both = pairs.join(side("a", "hub"), "hub").join(side("b", "uid"), "uid")
        both = both.where(f"{100 + percent} * (n_a + n_b - ({apart()})) >= {2 * percent} * (n_a + n_b)")
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
        shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
        p = percent / 100
        least = F.size(union) * p - 6 * F.sqrt(F.size(union) * p * (1 - p))
        likely = cut(both.where(shared >= least).select("hub", "uid"))
        return cut(in_blocks(likely).mapInArrow(_confirm(width, percent), "a long, b long"))

    # The rarest values of each sketch. Values of one document only are in no list but come first in the order.
    retained = classes.select(F.explode(F.slice("sketch", 1, LISTED)).alias("v"), "uid", "n")
    frequent = retained.groupBy("v").agg(F.count("*").alias("docs")).where("docs > 1")
    found = retained.join(frequent, "v")
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    # A set of over percent of the listed size may meet a larger one, of which only the smallest values are known.
    shared = F.when(F.col("n") * 100 <= percent * LISTED, need).otherwise(F.least(need, F.lit(least_shared(LISTED, percent))))
    alone = F.least(F.col("n"), F.lit(LISTED)) - F.count("*").over(Window.partitionBy("uid"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy("docs", "v"))
    first = found.withColumns({"place": place + alone, "last": F.least(F.col("n"), F.lit(LISTED)) - shared + 1}).where("place <= last")
    listed = stored(first.select("v", "uid", "n"), "listed")
    members = listed.join(listed.groupBy("v").count().where("count > 1").select("v"), "v")

    def named(lists: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of the lists that reach into several components, with the component of each member."""
        rows = lists.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        mixed = rows.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        return cut(rows.join(mixed.select("v"), "v"))

    def heads(lists: DataFrame, draws: int) -> DataFrame:
        """One member of each list, drawn by hash, with so many draws, so that lists of the same members share their heads."""
        draw = F.xxhash64(F.col("uid"), F.pmod(F.col("v"), F.lit(draws)))
        return lists.groupBy("v").agg(F.min(F.struct(draw.alias("draw"), "uid", "n")).alias("head"))

    def stars(lists: DataFrame) -> DataFrame:
        """Each member with its list's head. A document meets several heads."""
        fits = F.expr(f"uid <> head.uid and 100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
        return lists.join(heads(lists, 4), "v").where(fits).select(F.col("head.uid").alias("hub"), "uid").distinct()

    def across(lists: DataFrame) -> DataFrame:
        """Pairs of one list in different components whose sizes allow a link.

        Listed are values of a set of m values, the document's own or its difference from a pivot, by their place in
        it. The first value that a pair has in common leaves room for no more common ones than come after it in both;
        pairs that this bound or their parities rule out aren't made, nor are those of members both linked to a pivot.
        """
        lists = lists.join(classes.select("uid", "bits"), "uid")
        side = lambda x: [F.col("uid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "m", "root", "place", "bits", "linked")]]
        left, right = lists.select("v", *side("a")), lists.select("v", *side("b"))
        fits = F.expr(
            f"a < b and root_a <> root_b and not (linked_a and linked_b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
            f" and {100 + percent} * (m_a + m_b - 2 * (least(m_a - place_a, m_b - place_b) + 1)) <= {100 - percent} * (n_a + n_b)"
            f" and {100 + percent} * (n_a + n_b - ({apart()})) >= {2 * percent} * (n_a + n_b)"
        )
        return left.join(right, "v").where(fits).select(F.col("a").alias("hub"), F.col("b").alias("uid")).distinct()

    def rarest(sets: DataFrame, last: str) -> DataFrame:
        """Rows v, uid, n, m, linked, place of (space, v, uid, n, m, linked): values of several sets of a space up to the last place, rarest first."""
        counted = sets.join(sets.groupBy("space", "v").count().where("count > 1"), ["space", "v"])
        own = Window.partitionBy("space", "uid")
        alone = F.col("m") - F.count("*").over(own)
        first = counted.withColumn("place", alone + F.row_number().over(own.orderBy("count", "v"))).where(f"place <= {last}")
        return first.select(F.xxhash64("space", "v").alias("v"), "uid", "n", "m", "linked", "place")

    members = stored(members, "lists")
    tested = cut(stars(members))
    edges = confirmed(tested)
    roots = cut(connected_components(edges))

    open_lists = named(members, roots)
    sizes = open_lists.groupBy("v").agg(F.count("*").alias("size"))
    # The pair of a list of two has been tested.
    lists = open_lists.join(sizes.where(F.col("size").between(3, HOT_LIST)).select("v"), "v").select("v", "uid", "n", F.col("n").alias("m"), F.lit(1).alias("place"), F.lit(False).alias("linked"), "root")
    crowded = open_lists.join(sizes.where(F.col("size") > HOT_LIST).select("v"), "v")
    pivots = cut(crowded.join(heads(crowded, 1), "v").where("uid <> head.uid").select(F.col("head.uid").alias("hub"), "uid").distinct())
    if not pivots.isEmpty():
        moved = stored(in_blocks(pivots).mapInArrow(_differences(width, percent), "pivot long, uid long, n long, difference array<long>, linked boolean"), "differences")
        # Members linked to the pivot are linked through it, so pairs of such members need not be found.
        close = moved.where("pivot is not null and linked").select(F.least("uid", "pivot").alias("a"), F.greatest("uid", "pivot").alias("b"))
        edges = edges.unionByName(close)
        near = moved.where("pivot is not null").select(F.col("pivot").alias("space"), F.explode("difference").alias("v"), "uid", "n", F.size("difference").cast("long").alias("m"), "linked")
        far = with_texts(moved.where("pivot is null").select("uid").distinct()).mapInArrow(_same_set(width), "uid long, text string")
        # Rows that repeat both id and text bring a class's text several times; its values are to be counted once.
        whole = stored(far.groupBy("uid").agg(F.first("text").alias("text")), "crowded")
        # The driver sees at most BUCKETS common values, whatever the corpus. Any order finds every pair; this one keeps lists short.
        often = whole.mapInArrow(_repeated_values(width), "v long, times long").groupBy("v").agg(F.sum("times").alias("times"))
        common = often.orderBy(F.desc("times"), "v").limit(BUCKETS).select("v").toArrow().column("v").to_numpy()[::-1].copy()
        parts = cut(whole.mapInArrow(_rare_parts(width, percent, common), "v long, uid long, n long, place long"))
        parts = parts.join(parts.groupBy("v").count().where("count > 1").select("v"), "v")
        parts = parts.select("v", "uid", "n", F.col("n").alias("m"), F.lit(False).alias("linked"), "place")
        # Of two sets at the threshold, not both linked to the pivot, either has one of the values they share among these.
        again = rarest(near, f"least(m, floor(n * {100 - percent} / {percent}) + 1)").unionByName(parts)
        lists = lists.unionByName(named(cut(again), roots))
    # hub < uid in the pairs found now, either way in those tested.
    done = tested.select(F.least("hub", "uid").alias("hub"), F.greatest("hub", "uid").alias("uid"))
    edges = edges.unionByName(confirmed(across(lists).join(done, ["hub", "uid"], "left_anti")))
    roots = connected_components(edges)
    return sketched, cut(classes.join(roots, classes["uid"] == roots["node"], "left").select("one", "two", "rep", F.coalesce("root", "uid").alias("root")))


def _same_set(width: int):
    """Keep texts whose set is that of their class: a repeated id may bring other texts along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            texts = batch.column("text").to_pylist()
            wanted = zip(batch.column("one").to_pylist(), batch.column("two").to_pylist())
            good = [i for i, (text, key) in enumerate(zip(texts, wanted)) if _digest(shingle_set(text, width)) == key]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("uid")[i].as_py() for i in good], pa.int64()), pa.array([texts[i] for i in good], pa.string())], ["uid", "text"]
            )

    return run
