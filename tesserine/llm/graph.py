"""Candidate buckets, link verification in blocks and distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import cut

#: Hubs and members that one comparison task holds and sees.
HUBS, MEMBERS = 256, 1024
#: Shingle matches that are counted at once.
_HITS = 1 << 20
#: Words of 64 places in the outline of a set.
_OUTLINE = 16

#: Of an Arrow column: the values of all rows' sets one after another, and where each row's begin and end.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``edges(a, b)``; component is the smallest id that links reach.

    Each round hooks every node to its smallest neighbour, jumps pointers until every node of
    a tree points to its root (as many times as the logarithm of the depth), and contracts the
    edges to roots. A root that still has edges hooks or is hooked in the next round, so their
    number at least halves. A null end drops its edge. No edges: no rows.
    """
    edge = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    open_edges = edges.where("a <> b").select(*edge("a", "b")).distinct()
    out = None
    while out is None or not open_edges.isEmpty():
        both = open_edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        hooked = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p"))
        step = cut(_jump(hooked))
        while not step.where("p <> q").isEmpty():
            step = cut(_jump(step.select("x", F.col("q").alias("p"))))
        step = step.select("x", "p")
        ends = [step.select(F.col("x").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
        open_edges = cut(open_edges.join(ends[0], "a").join(ends[1], "b").where("pa <> pb").select(*edge("pa", "pb")).distinct())
        out = step.select(F.col("x").alias("id"), F.col("p").alias("component")) if out is None else _relabelled(out, step.select(F.col("x").alias("id"), F.col("p").alias("component")))
    return out


def _jump(parents: DataFrame) -> DataFrame:
    """``x, p`` with q, the parent of p."""
    return parents.join(parents.select(F.col("x").alias("p"), F.col("p").alias("q")), "p").select("x", "p", "q")


def _relabelled(found: DataFrame, later: DataFrame) -> DataFrame:
    """``found(id, component)`` with its components taken on to those of ``later``."""
    later = later.select(F.col("id").alias("component"), F.col("component").alias("q"))
    return found.join(later, "component", "left").select("id", F.coalesce("q", "component").alias("component"))


def crowded(members: DataFrame) -> DataFrame:
    """``bucket, id, hub`` of ``members(bucket, id)`` whose bucket may hold others; hub is one of its ids.

    Rows are dealt out by ranges of (bucket, id), so that a bucket of any size is shared by as many tasks as
    its rows need; one pass then looks at neighbours alone. Each task keeps its first and last
    row too, whose neighbours may be elsewhere: a bucket that lies in several tasks has a hub in each.
    """
    ordered = members.select("bucket", "id").repartitionByRange("bucket", "id").sortWithinPartitions("bucket")
    return ordered.mapInArrow(_neighbours, "bucket long, id long, hub long")


def crowded_dealt(members: DataFrame) -> DataFrame:
    """As ``crowded`` of ``members(bucket, id, hub)``, whose rows with a hub are decided and whose others hold each bucket few times.

    Buckets go by hash, at one pass over the rows that make them; rows that have a hub are dealt out by id. Rows may come again.
    """
    deal = F.when(F.col("hub").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "id"))
    return members.select("bucket", "id", "hub").repartition(deal).sortWithinPartitions("bucket", "id").mapInArrow(_undecided, "bucket long, id long, hub long")


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have a hub as they are; of the others, sorted by bucket and id, those whose bucket holds another id."""
    bucket, ids, hub, kept = np.empty(0, np.int64), np.empty(0, np.int64), None, False
    for b in batches:
        if not b.num_rows:
            continue
        own, b_ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        if b.column(2).null_count < b.num_rows:
            decided = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            yield _rows(own[decided], b_ids[decided], b.column(2).drop_null().to_numpy())
            own, b_ids = own[~decided], b_ids[~decided]
        bucket, ids = np.concatenate([bucket, own]), np.concatenate([ids, b_ids])
        if not len(ids):
            continue
        fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])])
        bucket, ids = bucket[fresh], ids[fresh]
        same = np.concatenate([[kept], bucket[1:] == bucket[:-1]])
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same[1:]]), np.arange(len(ids)), 0))
        hubs = ids[start]
        if hub is not None:
            hubs[start == 0] = hub
        rows = np.flatnonzero(same[:-1] | same[1:])
        if len(rows):
            yield _rows(bucket[rows], ids[rows], hubs[rows])
        hub, kept, bucket, ids = hubs[-1], same[-1], bucket[-1:], ids[-1:]
    if kept:
        yield _rows(bucket, ids, np.array([hub]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The last row so far waits for the next one: its bucket, id and hub, and whether it is kept in any case.
    bucket, ids, hub, kept = np.empty(0, np.int64), np.empty(0, np.int64), None, True
    for b in batches:
        if not b.num_rows:
            continue
        bucket, ids = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((bucket, ids)))
        same = np.concatenate([[kept], bucket[1:] == bucket[:-1]])
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same[1:]]), np.arange(len(ids)), 0))
        hubs = ids[start]
        if hub is not None:
            hubs[start == 0] = hub
        rows = np.flatnonzero(same[:-1] | same[1:])
        if len(rows):
            yield _rows(bucket[rows], ids[rows], hubs[rows])
        hub, kept, bucket, ids = hubs[-1], same[-1], bucket[-1:], ids[-1:]
    if hub is not None:
        yield _rows(bucket, ids, np.array([hub]))


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "id", "hub"])


def bucket_components(members: DataFrame, contents: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Components ``id, component`` of ids that share a bucket and whose sets have Jaccard similarity of ``percent`` or more.

    ``members(bucket, id, hub)`` is what ``crowded`` returns, materialised; ``contents(id, data)`` has what ``sets``
    reads. First every id is compared with the hubs of its buckets, which connects most of a large group at a row a
    member. Then, in each bucket of three or more that still holds several components, all rows outside the largest are
    compared with all rows. Sets are sent once to a task, pairs are never rows, and a task returns
    a spanning forest of the links it finds: large groups are dealt out in blocks of ``HUBS`` x ``MEMBERS``, small ones share
    a task. So no pair of a bucket is left undecided unless its ends are connected already.
    """
    groups = F.lit(max(1, members.count() // MEMBERS))
    stars = members.where("id <> hub").select("hub", "id").distinct()
    many, share = F.col("n") > HUBS, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / HUBS))
    task = F.when(many, F.xxhash64("hub", share)).otherwise(F.pmod(F.xxhash64("hub"), groups))
    hot = stars.groupBy("hub").agg(F.count("*").alias("n")).where(many)
    stars = stars.join(hot, "hub", "left").select(task.alias("task"), "hub", "id")
    hubs = stars.select("task", F.lit(0).alias("role"), F.col("hub").alias("id"))
    asked = hubs.union(stars.select("task", F.lit(1), "id")).distinct().withColumn("label", F.col("id"))
    links = cut(_compared(asked, contents, sets, percent))
    found = cut(components(links))

    own = members.join(found, "id", "left").select("bucket", "hub", "id", F.coalesce("component", "id").alias("label"))
    # A bucket whose rows lie in one task has one hub; with two rows it is decided.
    sizes = own.groupBy("bucket", "label").agg(F.count("*").alias("count"), F.min("hub").alias("low"), F.max("hub").alias("high"))
    sizes = sizes.groupBy("bucket").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("label", F.struct("count", "label")).alias("main"), F.min("low").alias("low"), F.max("high").alias("high"))
    mixed = cut(own.join(sizes.where("n > most and (n > 2 or low <> high)"), "bucket").select("bucket", "id", "label", "n", "most", "main"))
    blocks = [F.ceil((F.col("n") - F.col("most")) / HUBS), F.ceil(F.col("n") / MEMBERS)]
    mixed = mixed.withColumns({"hub_blocks": blocks[0].cast("int"), "member_blocks": blocks[1].cast("int"), "h": F.xxhash64("id")})
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    hubs = mixed.where("label <> main").select("bucket", "n", F.pmod("h", "hub_blocks").cast("int").alias("hb"), each("member_blocks").alias("mb"), F.lit(0).alias("role"), "id", "label")
    rest = mixed.select("bucket", "n", each("hub_blocks").alias("hb"), F.pmod("h", "member_blocks").cast("int").alias("mb"), F.lit(1).alias("role"), "id", "label")
    task = F.when(many, F.xxhash64("bucket", "hb", "mb")).otherwise(F.pmod(F.xxhash64("bucket"), groups))
    asked = hubs.union(rest).select(task.alias("task"), "role", "id", "label").distinct()
    later = cut(components(cut(_compared(asked, contents, sets, percent))))
    return _relabelled(found, later).unionByName(later.join(found, "id", "left_anti"))


def bucket_components_native(members: DataFrame, sketches: DataFrame, alike: Callable[[str, str], str], texts: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int, parts: int) -> DataFrame:
    """As ``bucket_components``, in joins and built-in functions alone; ``parts`` tasks compare.

    ``members(bucket, level, id, hub)``: every bucket has one hub, its smallest id, and an id at most once in it. ``alike`` is a
    condition on two values ``s`` of ``sketches(id, level, s)``; only pairs it holds for are compared on their sets. ``texts`` gives
    ``id, data`` of ``id`` and is asked once; ``sets`` replaces ``data`` by an array of distinct values, ``set``.
    Pairs with a hub come first, then in buckets that still hold several components all rows outside the largest with all rows.
    Of these last, only pairs become rows, once each, that the outlines of their sets leave open, which rule out no pair that is near.
    """
    held = members.join(sketches, ["id", "level"])
    hubs = sketches.select(F.col("id").alias("hub"), "level", F.col("s").alias("hub_s"))
    stars = members.where("id <> hub").select("hub", "id", "level").distinct().join(sketches, ["id", "level"]).join(hubs, ["hub", "level"])
    stars = compared = cut(stars.where(alike("hub_s", "s")).select("hub", "id").distinct())

    # Rows that are not like their hub may be like others of the bucket. Buckets of the same ids are looked at once.
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("ids")).where("n > 2").dropDuplicates(["n", "ids"]).select("bucket", "n")
    rest = cut(held.where("id <> hub").join(sizes, "bucket").select("bucket", "hub", "id", "s", "n"))
    apart = rest.join(stars, ["hub", "id"], "left_anti")
    some, others = _dealt(apart, F.col("n"), rest, ["id", "s"])
    some, others = some.select("task", F.col("id").alias("a"), F.col("s").alias("one")), others.select(F.col("task").alias("other_task"), F.col("id").alias("b"), F.col("s").alias("other"))
    like = F.expr(f"task = other_task and a <> b and {alike('one', 'other')}")
    loose = some.hint("merge").join(others, like, "left_semi").select(F.col("a").alias("id"))
    loose = loose.union(others.hint("merge").join(some, like, "left_semi").select(F.col("b")))
    wanted = cut(stars.select(F.explode(F.array("hub", "id")).alias("id")).union(loose).distinct())
    contents = cut(texts(wanted))

    hot = stars.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS)
    share = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("n", F.lit(1)) / MEMBERS))
    stars = stars.join(hot, "hub", "left").select(F.xxhash64("hub", share).alias("task"), "hub", "id")
    hubs = stars.select("task", F.col("hub").alias("id")).distinct().withColumn("label", F.col("id"))
    found = cut(components(cut(_joined(hubs, stars.select("task", "id", F.col("id").alias("label")), contents, sets, percent, parts))))

    # Ids without a text are like no other of their buckets.
    own = rest.join(contents.select("id"), "id", "left_semi").join(found, "id", "left").withColumn("label", F.coalesce("component", "id"))
    most = own.groupBy("bucket", "label").agg(F.count("*").alias("count")).groupBy("bucket").agg(F.sum("count").alias("m"), F.max("count").alias("most"), F.max_by("label", F.struct("count", "label")).alias("main"))
    mixed = cut(own.join(most.where("m > most"), "bucket").select("bucket", "id", "label", "s", "m", "most", "main"))
    places = mixed.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    mixed = cut(mixed.join(outlines(sets(contents.join(places.select("id"), "id", "left_semi"))).join(places, "id"), "id"))
    columns = ["bucket", "label", "s", "outline", "buckets"]
    some, others = _dealt(mixed.where("label <> main"), F.col("m") - F.col("most"), mixed.withColumnRenamed("m", "n").withColumn("first", F.col("label") == F.col("main")), ["id", *columns], ["id", "first", *columns])
    some, others = (x.select("task", F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in columns], *more) for x, i, more in ((some, "a", []), (others, "b", ["first"])))
    # Each pair once: of two rows outside the largest component from the smaller id, and in one of the buckets that both are in.
    once = "(first or a < b) and array_min(array_intersect(buckets_a, buckets_b)) = bucket_a"
    open_pairs = F.expr(f"bucket_a = bucket_b and label_a <> label_b and {alike('s_a', 's_b')} and {may_be_near('outline_a', 'outline_b', percent)} and {once}")
    pairs = some.hint("merge").join(others, "task").where(open_pairs)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, label_a, label_b)").alias("label_a"), F.expr("if(a < b, label_b, label_a)").alias("label_b"))
    pairs = cut(pairs.join(compared.select(F.col("hub").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_anti"))  # a hub is its bucket's smallest id
    ends = pairs.withColumn("task", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(16))))
    hubs = ends.select("task", F.col("a").alias("id"), F.col("label_a").alias("label")).distinct()
    later = cut(components(cut(_joined(hubs, ends.select("task", F.col("b").alias("id"), F.col("label_b").alias("label")), contents, sets, percent, parts))))
    return _relabelled(found, later).unionByName(later.join(found, "id", "left_anti"))


def outlines(made: DataFrame) -> DataFrame:
    """``id, outline`` of ``made(id, set)``: the size of a set, and for each of ``64 * _OUTLINE`` places whether an odd number of its values fall on it."""
    rows = made.select("id", F.size("set").alias("size"), F.explode("set").alias("h"))
    words = [F.expr(f"bit_xor(if(pmod(shiftright(h, 6), {_OUTLINE}) = {j}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"o{j}") for j in range(_OUTLINE)]
    return rows.groupBy("id", "size").agg(*words).select("id", F.struct("size", *[f"o{j}" for j in range(_OUTLINE)]).alias("outline"))


def may_be_near(one: str, other: str, percent: int) -> str:
    """Whether two outlines may be of sets with similarity ``percent`` or more. A place that differs takes a value of its own that only one of the sets has, so this holds for every pair that is near."""
    both = f"({one}.size + {other}.size)"
    apart = " + ".join(f"bit_count({one}.o{j} ^ {other}.o{j})" for j in range(_OUTLINE))
    return f"100 * least({one}.size, {other}.size) >= {percent} * greatest({one}.size, {other}.size) and {100 + percent} * ({apart}) <= {100 - percent} * {both}"


def _dealt(some: DataFrame, n_some: Column, others: DataFrame, columns: list[str], others_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``task`` and ``columns`` of both (``others_columns`` of the others, if given), so that each row of ``some(bucket, ...)`` meets each of ``others(bucket, n, ...)``: in blocks where a bucket is large."""
    counts = some.select("bucket", n_some.alias("k")).distinct().groupBy("bucket").agg(F.max("k").alias("k"))
    blocks = others.select("bucket", "n").distinct().join(counts, "bucket").select("bucket", F.ceil(F.col("k") / HUBS).cast("int").alias("hub_blocks"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("member_blocks"))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    place = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    some = some.join(blocks, "bucket").select(F.col("bucket").alias("of"), place("hub_blocks").alias("hb"), each("member_blocks").alias("mb"), *columns)
    others = others.join(blocks, "bucket").select(F.col("bucket").alias("of"), each("hub_blocks").alias("hb"), place("member_blocks").alias("mb"), *(others_columns or columns))
    return tuple(x.select(F.xxhash64("of", "hb", "mb").alias("task"), *c) for x, c in ((some, columns), (others, others_columns or columns)))


def _joined(some: DataFrame, others: DataFrame, contents: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, parts: int) -> DataFrame:
    """Links ``a, b`` between labels of ``some(task, id, label)`` and ``others``, of each task; sets are made once a row, where they are compared."""
    one, other = (sets(x.join(contents, "id").select("task", "label", "data").repartition(parts, "task")).select("task", F.col("label").alias(c), F.col("set").alias(f"set_{c}"), F.size("set").alias(f"n_{c}")) for x, c in ((some, "a"), (others, "b")))
    near = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return one.hint("merge").join(other, "task").where((F.col("a") != F.col("b")) & near & (shared * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b").distinct()


def _compared(asked: DataFrame, contents: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links ``a, b`` between labels of ``asked(task, role, id, label)``: of role 1 with role 0 in each task."""
    given = asked.join(contents, "id").select("task", "role", "label", "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, hubs = None, None
        for b in batches:
            tasks, roles, labels = (b.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.concatenate([[True], (tasks[1:] != tasks[:-1]) | (roles[1:] != roles[:-1])])) if len(tasks) else []
            for at, end in zip(edges, [*edges[1:], len(tasks)], strict=True):
                if tasks[at] != task:
                    task, hubs = tasks[at], _Hubs(percent)
                for own in (slice(i, min(i + 512, end)) for i in range(at, end, 512)):
                    values, offsets = sets(b.column(3).slice(own.start, own.stop - own.start))
                    if roles[at] == 0:
                        hubs.add(values, offsets, labels[own])
                    elif hubs.labels:
                        a, c = hubs.links(values, offsets, labels[own])
                        if a:
                            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return given.repartition("task").sortWithinPartitions("task", "role").mapInArrow(compare, "a long, b long")


class _Hubs:
    """The hubs of a task: an inverted index of their sets, and which are connected already."""

    def __init__(self, percent: int) -> None:
        self.percent, self.labels, self.sizes, self.values, self.index = percent, [], [], [], None

    def add(self, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> None:
        self.values.append(values)
        self.sizes += np.diff(offsets).tolist()
        self.labels += labels.tolist()

    def _built(self) -> None:
        flat = np.concatenate(self.values)
        order = np.argsort(flat, kind="stable")
        self.size = np.array(self.sizes, np.int64)
        known, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.index = known, first, count, np.repeat(np.arange(len(self.size)), self.size)[order]
        self.values = []
        self.label = np.array(self.labels, np.int64)
        self.root = np.unique(self.label, return_inverse=True)[1]

    def links(self, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[list[int], list[int]]:
        """Edges that connect labels of the given sets with those of hubs; none that earlier ones imply among the hubs."""
        if self.index is None:
            self._built()
        known, first, counts, owner = self.index
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        low, count = first[at], np.where(known[at] == values, counts[at], 0)
        hits = np.concatenate([[0], np.cumsum(count)])[offsets]
        a, b, at = [], [], 0
        while at < len(labels):
            end = max(at + 1, int(np.searchsorted(hits, hits[at] + _HITS, "right")) - 1)
            end = min(end, at + max(1, 4 * _HITS // len(self.size)))
            part = slice(offsets[at], offsets[end])
            c = count[part]
            where = np.repeat(low[part] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            row = np.repeat(np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1])), c)
            shared = np.bincount(row * len(self.size) + owner[where], minlength=(end - at) * len(self.size)).reshape(end - at, -1)
            union = np.diff(offsets[at : end + 1])[:, None] + self.size[None] - shared
            linked = (100 * shared >= self.percent * union) & (shared > 0)
            for i in np.flatnonzero(linked.any(axis=1)):
                mine = np.flatnonzero(linked[i])
                roots, first = np.unique(self.root[mine], return_index=True)
                a += [int(labels[at + i])] * len(roots)
                b += self.label[mine[first]].tolist()
                for r in roots[1:]:
                    self.root[self.root == r] = roots[0]
            at = end
        return a, b
