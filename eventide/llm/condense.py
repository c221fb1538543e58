"""The condensed hierarchy of a spanning forest, and its most stable clusters.

Edges are taken in ascending order. A node of the hierarchy needs only a size, and above the least cluster size the sum of the
densities at which its members leave; so states merge in constant time. Where two clusters meet, both end and a wider one begins; smaller
parts that join a cluster are members that leave it at that density. Of a cluster and those within it, whichever is more stable is kept.
A linked group of two or more that never reaches the least size is one cluster, whole.

The edges of a group are cut into bands of bounded size in their order. A task takes the next band of a group with the states of the parts that its edges
join, and leaves one state for each part that it makes; so no task holds a group, and groups go on side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from .density import neighbour_graph
from .forest import spanning_forest

#: The least distance that tells densities apart; edges of a band; rows of a partition that are condensed together.
FINEST, BAND, TOGETHER = 1e-3, 250_000, 200_000
#: A part of a group: its size, and either its open cluster (``cid``: the sum of what left it, the worth of the clusters within it) or its loose members, with
#: the density at which the last of them joined.
_STATE = "root bigint, id bigint, size bigint, cid string, total double, inner double, within boolean, loose array<bigint>, joined double"
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_OUT = f"kind tinyint, {_STATE}"
_HOME, _CLUSTER, _MOVED, _PART = range(4)


class Part:
    """The state of one part."""

    __slots__ = ("cid", "id", "inner", "joined", "loose", "size", "total", "within")

    def __init__(self, id: int, size: int, cid: str | None, total: float, inner: float, within: bool, loose: list[int] | None, joined: float):
        self.id, self.size, self.cid, self.total, self.inner, self.within, self.loose, self.joined = id, size, cid, total, inner, within, loose, joined

    def closed(self, density: float) -> tuple[bool, float]:
        """Whether its cluster is chosen before those within it, and the worth of the better ones, where it ends at ``density``."""
        own = self.total - self.size * density
        return not self.within or own >= self.inner, max(own, self.inner) if self.within else own


class Condenser:
    """Takes edges in ascending order and collects rows ``(kind, root, id, size, cid, total, inner, within, loose, joined)``.

    A home row tells the cluster (``cid``) of a node (``id``) and the density (``total``) at which it leaves it; a cluster row has in ``cid`` a cluster,
    the next one around it that is still open and the widest chosen one before that ("-" for none); a moved row tells that part ``id`` is in part ``size`` now.
    """

    def __init__(self, root: int, band: int, least: int):
        self.root, self.band, self.least = root, band, least
        self.parts: dict[int, Part] = {}
        self.above: dict[int, int] = {}
        self.rows: list[tuple] = []
        self.ended: list[tuple[str, str | None, bool]] = []
        self.opened = 0

    def home(self, node: int, cid: str, density: float) -> None:
        self.rows.append((_HOME, self.root, node, 0, cid, density, 0.0, False, None, 0.0))

    def begin(self, part: Part, members: list[int], density: float) -> None:
        """Opens the cluster of a part."""
        part.cid = f"{self.root}:{self.band}:{self.opened}"
        self.opened += 1
        for k in members:
            self.home(k, part.cid, density)
        part.total, part.inner, part.within, part.loose = part.size * density, 0.0, False, None

    def add(self, part: Part) -> None:
        self.parts[part.id] = part
        self.above[part.id] = part.id
        if part.cid is None and part.size >= self.least:  # a node of many copies
            self.begin(part, part.loose, 1 / FINEST)

    def find(self, k: int) -> int:
        above = self.above
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    def edge(self, a: int, b: int, distance: float) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        at, x, y = 1 / max(distance, FINEST), self.parts[a], self.parts[b]
        if x.size < y.size:
            x, y = y, x
        self.above[y.id] = x.id
        del self.parts[y.id]
        if x.cid and y.cid:
            ended = [(p.cid, *p.closed(at)) for p in (x, y)]
            x.size += y.size
            self.begin(x, [], at)
            x.inner, x.within = sum(worth for _, _, worth in ended), True
            self.ended += [(cid, x.cid, chosen) for cid, chosen, _ in ended]
        elif x.cid:
            for k in y.loose:
                self.home(k, x.cid, at)
            x.total += y.size * at
            x.size += y.size
        else:
            x.size += y.size
            x.loose = x.loose + y.loose
            x.joined = at
            if x.size >= self.least:
                self.begin(x, x.loose, at)

    def end(self, last: bool, furthest: float) -> list[tuple]:
        """All rows; ``last`` closes the parts at the furthest distance, else they are given as states."""
        for p in list(self.parts.values()):
            if not last:
                self.rows.append((_PART, self.root, p.id, p.size, p.cid, p.total, p.inner, p.within, p.loose, p.joined))
                continue
            if p.cid is None and p.size >= 2:
                self.begin(p, p.loose, p.joined)
            if p.cid:
                self.ended.append((p.cid, None, p.closed(1 / max(furthest, FINEST))[0]))
        if not last:
            self.rows += [(_MOVED, self.root, k, self.find(k), None, 0.0, 0.0, False, None, 0.0) for k in self.above if self.above[k] != k]
        way: dict[str, tuple[str | None, str | None]] = {}
        for cid, up, chosen in reversed(self.ended):  # those around come first
            best = cid if chosen else None
            if up in way:
                up, widest = way[up]
                best = widest or best
            way[cid] = up, best
            self.rows.append((_CLUSTER, self.root, 0, 0, f"{cid} {up or '-'} {best or '-'}", 0.0, 0.0, False, None, 0.0))
        return self.rows


def _condensing(band: int, least: int, furthest: float):
    """Takes rows (root, final, a, b, distance, state of a part where b is null), together for each root."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        root, final = table.column("root").to_numpy(), table.column("final").to_numpy()
        edge = table.column("b").is_valid().to_numpy()
        part, line = np.flatnonzero(~edge), np.flatnonzero(edge)
        states = list(zip(*(table.column(k).take(pa.array(part)).to_pylist() for k in _STATE_NAMES[1:])))
        a, b, ta, tb, d = (table.column(k).take(pa.array(line)).to_numpy() for k in ("a", "b", "ta", "tb", "distance"))
        order = np.lexsort((tb, ta, d, root[line]))
        edges = list(zip(*(x[order].tolist() for x in (a, b, d))))
        each, first = np.unique(root, return_index=True)
        of_part, of_line = ([*np.searchsorted(root[own], each).tolist(), len(own)] for own in (part, line))
        rows: list[tuple] = []
        for k, (r, last) in enumerate(zip(each.tolist(), final[first].tolist())):
            c = Condenser(r, band, least)
            for v in states[of_part[k] : of_part[k + 1]]:
                c.add(Part(*v))
            for x, y, distance in edges[of_line[k] : of_line[k + 1]]:
                c.edge(x, y, distance)
            rows += c.end(last, furthest)
        types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 10, types)], names=["kind", *_STATE_NAMES])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            held.append(batch)
            n += len(batch)
            if n >= TOGETHER:
                table = pa.Table.from_batches(held)
                root = table.column("root").to_numpy()
                last = int(np.searchsorted(root, root[-1]))  # its rows may go on
                if last:
                    yield finish(table.slice(0, last))
                held = table.slice(last).to_batches()
                n = len(table) - last
        if n:
            yield finish(pa.Table.from_batches(held))

    return run


def condensed(nodes: DataFrame, tree: DataFrame, least: int, furthest: float, band: int | None = None) -> DataFrame:
    """``(id, cid, persistence)``: the selected cluster of each node that is in one, and the density at which the node leaves it.

    ``nodes`` are (root, id, copies), a node for each different vector, ``tree`` the forest's edges (root, a, b, distance). Each step takes
    the next band of about ``band`` edges of every group that has one left.
    """
    band = BAND if band is None else band
    edges = tree.count()
    placed = tree.repartitionByRange(-(-edges // band) or 1, "root", "distance", "a", "b").withColumn("band", F.spark_partition_id())
    placed = runtime.cut(placed)
    span = placed.groupBy("root").agg(F.min("band").alias("first"), F.max("band").alias("last"))
    steps = (span.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0) + 1
    many = runtime.cut(span)
    placed = placed.join(many, "root").select("root", (F.col("band") - F.col("first")).alias("step"), (F.col("last") - F.col("first")).alias("end"), "a", "b", "distance")
    empty = {"size": F.lit(1).cast("bigint"), "cid": F.lit(None).cast("string"), "total": F.lit(0.0), "inner": F.lit(0.0), "within": F.lit(False), "loose": F.lit(None).cast("array<bigint>"), "joined": F.lit(1 / FINEST)}
    ends = many.select("root", (F.col("last") - F.col("first")).alias("end"))
    parts = nodes.join(ends, "root", "left").select("root", F.coalesce("end", F.lit(0)).alias("end"), "id", *(v.alias(k) for k, v in {**empty, "size": F.col("copies"), "loose": F.array("id")}.items()), F.col("end").isNull().alias("alone"))
    parts = parts.filter(~F.col("alone") | (F.col("size") > 1)).drop("alone")  # a vector alone is in no cluster
    where = None  # the part of each node of the groups that go on
    done = []
    for step in range(steps):
        now = placed.filter(F.col("step") == step).withColumns({"ta": F.col("a"), "tb": F.col("b")})
        own = parts
        if step:
            for c in ("a", "b"):
                now = now.drop(c).join(where.select(F.col("node").alias(f"t{c}"), F.col("part").alias(c)), f"t{c}")
        if steps > 1:  # a group is connected, so a part that its next edges don't touch waits for later ones
            touched = now.select(F.col("a").alias("id")).union(now.select(F.col("b").alias("id"))).distinct()
            waiting = parts.filter(F.col("end") > 0).join(touched, "id", "left_anti")
            own = parts.filter((F.col("end") == 0) & F.lit(step == 0)).unionByName(parts.filter(F.col("end") > 0).join(touched, "id", "left_semi").select(parts.columns))
        last = (F.col("end") == step).alias("final")
        none = F.lit(None)
        rows = own.select("root", last, none.cast("bigint").alias("a"), none.cast("bigint").alias("b"), F.lit(0.0).alias("distance"), none.cast("bigint").alias("ta"), none.cast("bigint").alias("tb"), *_STATE_NAMES[1:])
        rows = rows.unionByName(now.select("root", last, "a", "b", "distance", "ta", "tb", F.lit(0).cast("bigint").alias("id"), *(v.alias(k) for k, v in empty.items())))
        # by a hash of its own: a union of joins by root looks as if it were laid out by root already, which a broadcast chosen at run time undoes
        out = runtime.cut(rows.repartition(F.xxhash64("root")).sortWithinPartitions("root").mapInArrow(_condensing(step, least, furthest), _OUT))
        done.append(out)
        if step + 1 < steps:
            made = out.filter(F.col("kind") == _PART).join(ends, "root").select("root", "end", *_STATE_NAMES[1:])
            parts = runtime.cut(waiting.select(made.columns).unionByName(made))
            moved = out.filter(F.col("kind") == _MOVED).select(F.col("id").alias("part"), F.col("size").alias("to"))
            if where is None:
                where = nodes.join(ends.filter("end > 0"), "root").select(F.col("id").alias("node"), F.col("id").alias("part"))
            where = runtime.cut(where.join(moved, "part", "left").select("node", F.coalesce("to", "part").alias("part")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    # the widest chosen cluster around each one: tasks have told it up to what was open then, doubling goes the way to the top
    name = F.split("cid", " ")
    known = lambda k: F.when(name[k] != "-", name[k])
    way = runtime.cut(rows.filter(F.col("kind") == _CLUSTER).select(name[0].alias("cid"), known(1).alias("up"), known(2).alias("best")))
    while way.filter("up IS NOT NULL").limit(1).count():
        further = way.select(F.col("cid").alias("up"), F.col("up").alias("up2"), F.col("best").alias("best2"))
        way = runtime.cut(way.join(further, "up", "left").select("cid", F.col("up2").alias("up"), F.coalesce("best2", "best").alias("best")))
    homes = rows.filter(F.col("kind") == _HOME).select("id", "cid", F.col("total").alias("persistence"))
    return homes.join(way.select("cid", "best"), "cid").select("id", F.col("best").alias("cid"), "persistence")


def clusters(records: DataFrame, least_cosine: float, *, least_size: int = 3, min_samples: int = 2) -> DataFrame:
    """``(group, lead, id, persistence)``: the most stable density clusters of vectors; ``lead`` is the smallest id of the cluster, or null for vectors in none,
    ``group`` the smallest id of all that are linked, the hierarchy cut at its furthest distance, 1 - ``least_cosine``.

    A cluster has at least ``least_size`` vectors; a linked group of two or more, but fewer than that, is one cluster. ``persistence`` is the density (1 / distance) at which a vector leaves its cluster as the
    distance shrinks; those with the greatest are its most typical members. Every vector has a row.
    """
    if least_size < 2:
        raise ValueError("least_size must be 2 or more")
    edges, member = neighbour_graph(records, least_cosine, min_samples)
    tree, root = spanning_forest(edges)
    member = runtime.cut(member)
    nodes = member.groupBy("rep").agg(F.count("*").alias("copies")).join(root.withColumnRenamed("id", "rep"), "rep", "left")
    nodes = runtime.cut(nodes.select(F.coalesce("root", "rep").alias("root"), F.col("rep").alias("id"), "copies"))
    placed = tree.join(root.withColumnRenamed("id", "a"), "a").select("root", "a", "b", "distance")
    home = condensed(nodes, placed, least_size, 1 - least_cosine)
    found = nodes.join(home, "id", "left").select("root", F.col("id").alias("rep"), "cid", F.coalesce("persistence", F.lit(0.0)).alias("persistence"))
    group = nodes.groupBy("root").agg(F.min("id").alias("group"))
    lead = found.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("rep").alias("lead"))
    found = found.join(group, "root").join(lead, "cid", "left").select("rep", "group", "lead", "persistence")
    return member.join(found, "rep").select("group", "lead", "id", "persistence")


def described(members: DataFrame, sizes: DataFrame, id_col: str, count_col: str, exemplars: int = 3) -> DataFrame:
    """``(lead, members, doc_count, exemplars)`` of each cluster: how many members, the sum of their counts, and its most persistent members (9 digits; ties by id)."""
    count = sizes.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(count_col).alias("n"))
    held = members.filter("lead IS NOT NULL")
    total = held.join(count, "id", "left").groupBy("lead").agg(F.count("*").alias("members"), F.sum(F.coalesce("n", F.lit(0))).alias("doc_count"))
    best = held.withColumn("k", F.row_number().over(Window.partitionBy("lead").orderBy(F.desc(F.round("persistence", 9)), "id"))).filter(F.col("k") <= exemplars)
    best = best.groupBy("lead").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("exemplars"))
    return total.join(best, "lead")
