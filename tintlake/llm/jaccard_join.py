"""Exact n-gram Jaccard join in a metric space.

Jaccard distance is a metric, so pivots part the texts: a text measured against a pivot lies at a distance d, and texts that
link with it lie between d - eps and d + eps from the same pivot. Over a corpus nearly all texts are at distance 1 from any
pivot, which tells nothing; so a text is measured only against pivots that it shares a slice with. Slices prune: all sets of
a class of sizes are cut at the same hashes into more slices than linked sets may differ in, so linked sets send an equal
slice. The least set that holds a slice is its pivot.

1. Cells. Every set is measured against the pivots of its slices and belongs to the cell of each: it is at home with the
   nearest and copied to the others, whose boundary it lies on. Linked sets share a slice, so they share a cell.
2. Sets within eps of their pivot are linked to it. Cells whose sets are all linked are settled, and so are cells of two
   sets, as their one distance is known.
3. Open cells are joined recursively. Pivots of different classes are chosen in the cell, each set falls to the Voronoi
   region of its nearest, and the triangle inequality gives the windows: it is copied to every pivot at most 2 * eps farther
   than its own. A cell that fits a task is parted there, down to regions of LEAF sets, where sets meet only if no pivot
   puts them more than eps apart. A larger one is parted by a distributed step, its members dealt out by a salt, until its
   regions fit. A region that windows don't part (all its sets within 2 * eps of all its pivots) is dealt out: only its sets
   outside the largest class are looked up, in blocks, as sets of one class need no comparison.

The order of slices puts those last that hold the `MOST_FREQUENT` shingles that most texts repeat, by counts over all texts.
Any order gives the same links; this one keeps passages that many texts share from forming cells.

Equal sets (128 bits of hash over 64-bit shingle hashes) are joined as one, by the least id that has them. Null or empty
text: no shingles, a class of its own. A null id takes the class of its set; if no row with that set has an id, its class is
null. Repeated rows get equal results; a repeated id with other texts stands for each of them. Very long texts are one set
like any other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintlake.llm.components import components
from tintlake.llm.shared import blocks, only, stored, utf8

#: Ratio of the sizes in a class of sizes.
RATIO = 1.5
#: Share of slices that a text leaves out, over those it needs.
SPARE = 0.25
#: Frequent shingles that the order knows, and in how many texts of a batch one must be to be counted.
MOST_FREQUENT, REPEATED = 200_000, 3
#: A cell of more sets or shingles doesn't go to one task.
MOST_TEXTS, MOST_SHINGLES = 1000, 1_000_000
#: A region of fewer sets isn't parted further.
LEAF = 12
PIVOTS = 8

_WHITE = np.zeros(256, np.bool_)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        back = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers, _inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in (_ODD, back))
    return _powers, _inverse


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending hashes: of k words, or of all words where there are fewer."""
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(bounds) - 1)
    power, inverse = _power_tables(len(data) + 1)
    inside = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, np.bool_)
    edge[bounds[:-1]] = True  # a word doesn't reach into the next text
    before = np.concatenate(([False], inside))[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside, [False]))[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], dtype=np.uint64)))
    words = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD)
    first = np.searchsorted(start, bounds)
    grams = words[: max(len(words) - k + 1, 0)].copy()
    for i in range(1, k):
        grams = mix(grams + np.uint64(i)) + words[i : len(words) - k + 1 + i]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(mix(grams[a : b - k + 1]))
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mix(h * _ODD + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of the whole set, as signed longs."""
    n = np.uint64(len(s))
    one = mix(np.bitwise_xor.reduce(mix(s ^ _ODD), keepdims=True) + n) ^ mix(s.sum(dtype=np.uint64, keepdims=True) + n)
    two = mix(mix(s + _ODD).sum(dtype=np.uint64, keepdims=True) ^ n)
    return int(one.astype(np.int64)[0]), int(two.astype(np.int64)[0])


@dataclass(frozen=True)
class Similarity:
    """Texts link when den * intersection >= num * union of their shingles of k words."""

    k: int = 3
    num: int = 90
    den: int = 100

    @property
    def eps(self) -> float:
        return 1 - self.num / self.den

    def partner(self, n: int) -> int:
        """The largest set that may link with one of n."""
        return n * self.den // self.num

    def differ(self, both: int) -> int:
        """Shingles that linked sets may differ in, by the sum of their sizes."""
        return both * (self.den - self.num) // (self.den + self.num)


Order = np.ndarray  # frequent shingles, ascending


_starts: list[int] = [1]


def size_class(n: int) -> int:
    """Classes of sizes grow by RATIO; their bounds are worked out as far as they are asked for."""
    while _starts[-1] <= n:
        _starts.append(max(_starts[-1] + 1, int(_starts[-1] * RATIO)))
    return bisect.bisect_right(_starts, n) - 1


def slices(s: np.ndarray, sim: Similarity, order: Order) -> np.ndarray:
    """The hashes of the slices that a set sends, in its class of sizes and in those of larger partners.

    All sets of a class are cut at the same hashes. Of T = h + 1 + e slices the e that say least are left out: those with the
    fewest rare shingles, by a rule that looks at a slice's content alone. Two sets that differ in h shingles or fewer have
    e + 1 equal slices or more; the one of these that says most is not among the e worst of either, so both send it.
    """
    out = []
    keys = order
    rare = np.ones(len(s), np.int64)
    if len(keys):
        rare = (keys[np.minimum(np.searchsorted(keys, s), len(keys) - 1)] != s).astype(np.int64)
    rare = np.concatenate(([0], np.cumsum(rare)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)))
    top = size_class(sim.partner(len(s)))  # first, as it also sets the bounds of the classes
    for c in range(size_class(len(s)), top + 1):
        most = _starts[c + 1] - 1
        if sim.differ(len(s) + most) < 1:
            continue  # only equal sets, which are one already
        differ = sim.differ(2 * most)
        spare = int(np.ceil((differ + 1) * SPARE))
        t = differ + 1 + spare
        cut = np.searchsorted((s >> np.uint64(32)) * np.uint64(t) >> np.uint64(32), np.arange(t + 1, dtype=np.uint64))
        h = mix(total[cut[1:]] - total[cut[:-1]] + mix((np.arange(t, dtype=np.uint64) << np.uint64(16)) + np.uint64(c) + np.diff(cut).astype(np.uint64) * _ODD))
        out.append(h[np.lexsort((h, rare[cut[1:]] - rare[cut[:-1]]))[spare:]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def frequent(docs: DataFrame, sim: Similarity, most: int = MOST_FREQUENT) -> Order:
    """The shingles that most texts repeat, from counts over all blocks; so many go to the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_by_block(batch.column(1), sim.k):
                own = {set_id(s): s for s in sets if len(s)}
                if own:
                    grams, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
                    keep = n >= REPEATED
                    yield pa.RecordBatch.from_arrays([pa.array(grams[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], names=["gram", "n"])

    top = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(most).select("gram").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.uint64))


def _sets_by_block(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, bounds = utf8(column)
    for i, j in blocks(bounds):
        yield i, shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k)


def sizes(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n, sid and check (null for a text without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = [], []
            for _, sets in _sets_by_block(batch.column(1), sim.k):
                n += [len(s) for s in sets]
                ids += [set_id(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array([i[c] for i in ids], pa.int64()) for c in range(2))], names=["doc_id", "n", "sid", "check"])

    return docs.mapInArrow(run, "doc_id long, n long, sid long, check long")


def slice_pivots(docs: DataFrame, sim: Similarity, order: Order) -> DataFrame:
    """sid, pivot: a set and the pivot of one of its slices, if that is another set.

    A block sends each slice once, with its least set, and names its other sets as followers of that slice. So a slice that
    many texts hold comes together once for each block; followers take its pivot by a join whose hot side Spark may split.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_by_block(batch.column(1), sim.k):
                own = {set_id(s)[0]: s for s in sets if len(s)}
                if not own:
                    continue
                sent = [slices(s, sim, shared.value) for s in own.values()]
                h = np.concatenate(sent)
                sid = np.repeat(np.fromiter(own, np.int64, len(own)), [len(x) for x in sent])
                order = np.lexsort((sid, h))
                h, sid = h[order], sid[order]
                first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                again = ~first & np.concatenate(([False], sid[1:] != sid[:-1])) if len(h) else first
                role = np.where(first, np.append(~first[1:], False), 2).astype(np.int32)  # 0 alone in the block, 1 leads, 2 follows
                keep = first | again
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].astype(np.int64)), pa.array(sid[keep]), pa.array(role[keep])], names=["slice", "sid", "role"])

    rows = docs.mapInArrow(run, "slice long, sid long, role int")
    place = F.when(F.col("role") < 2, F.col("slice")).otherwise(F.xxhash64("slice", "sid"))
    pivot = F.min(F.when(F.col("role") < 2, F.col("sid"))).over(Window.partitionBy("place"))
    rows = rows.withColumn("place", place).withColumn("pivot", pivot).where("role > 0 or sid <> pivot").select("slice", "sid", "role", "pivot")
    rows = stored(rows, "slices")  # only those that more than one set holds
    pivots = stored(rows.where("role < 2").groupBy("slice").agg(F.min("pivot").alias("pivot")), "pivots")
    followers = rows.where("role = 2").select("slice", "sid").join(pivots, "slice").select("sid", "pivot")
    return rows.where("role < 2").select("sid", "pivot").union(followers).where("sid <> pivot").distinct()


class Forest:
    def __init__(self, labels: np.ndarray):
        """labels: the group each member is already in."""
        self.label, self.links = np.unique(labels, return_inverse=True)[1], []

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if self.label[i] != self.label[j]:
                self.links.append((i, j))
                self.label[self.label == self.label[j]] = self.label[i]


class Region:
    """The sets of a region, joined by pivots."""

    def __init__(self, sets: list[np.ndarray], sim: Similarity, labels: np.ndarray):
        self.sim, self.size = sim, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        self.values, self.code = np.unique(flat, return_inverse=True)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.forest = Forest(labels)
        self.mark = np.zeros(len(self.values), np.bool_)

    def shared(self, i: int, members: np.ndarray) -> np.ndarray:
        """Shingles that each member has in common with text i."""
        own = self.code[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        size = self.size[members]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) - np.repeat(ends - size - self.at[members], size)
        hit = np.concatenate(([0], np.cumsum(self.mark[self.code[where]])))
        self.mark[own] = False
        return hit[ends] - hit[ends - size]

    def distance(self, i: int, members: np.ndarray) -> np.ndarray:
        """Distances to text i. Links are decided in whole numbers on the way."""
        both = self.shared(i, members)
        union = self.size[members] + self.size[i] - both
        self.forest.join(i, members[self.sim.den * both >= self.sim.num * union])
        return 1 - both / union

    def open(self, members: np.ndarray) -> bool:
        return len(members) > 1 and bool((self.forest.label[members] != self.forest.label[members[0]]).any())

    def run(self, members: np.ndarray) -> None:
        """Joins the members, as far as they are of different groups."""
        stack = [members]
        while stack:
            members = stack.pop()
            if not self.open(members):
                continue
            pivots, away = [], np.full((0, len(members)), 0.0)
            nearest = np.full(len(members), np.inf)
            for _ in range(min(PIVOTS, len(members))):  # far apart: the next is the farthest from those before
                i = int(np.argmax(nearest)) if pivots else int(np.argmax(self.size[members]))
                if pivots and nearest[i] == 0:
                    break
                d = self.distance(int(members[i]), members)
                pivots.append(i)
                away = np.concatenate((away, d[None, :]))
                nearest = np.minimum(nearest, d)
            if not self.open(members):
                continue
            if len(members) > LEAF and len(pivots) > 1:
                inside = away <= nearest[None, :] + 2 * self.sim.eps + 1e-9
                if inside.sum() <= 2 * len(members) and inside.sum(1).max() <= 0.8 * len(members):
                    stack += [members[row] for row in inside]
                    continue
            self.leaf(members, away)

    def leaf(self, members: np.ndarray, away: np.ndarray) -> None:
        size, label = self.size[members], self.forest.label
        for j in range(len(members)):
            i = int(members[j])
            small, large = np.minimum(size, size[j]), np.maximum(size, size[j])
            near = (label[members] != label[i]) & (self.sim.den * small >= self.sim.num * large)
            near[: j + 1] = False
            if near.any():
                near &= (np.abs(away - away[:, j : j + 1]) <= self.sim.eps + 1e-9).all(0)
                if near.any():
                    self.distance(i, members[near])


def join_groups(rows: DataFrame, sim: Similarity, keys: list[str]) -> DataFrame:
    """a, b: links between sets of one group. rows: the keys, node, label (class within which links are known) and text."""

    def links(held: dict[int, tuple[int, str]]) -> list[tuple[int, int]]:
        ids = sorted(held)
        if len(ids) < 2:
            return []
        sets = [s for _, part in _sets_by_block(pa.array([held[i][1] for i in ids], pa.large_string()), sim.k) for s in part]
        region = Region(sets, sim, np.array([held[i][0] for i in ids]))
        region.run(np.arange(len(ids)))
        return [(ids[i], ids[j]) for i, j in region.forest.links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []
        for batch in batches:
            for *now, node, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if held:
                        out += links(held)
                    key, held = now, {}
                held[node] = (label, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
                out = []
        if held and (out := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return rows.select(*keys, "node", "label", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def measured(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """cell, node, n, pivot_n, link: the sizes of a set and of the pivot whose cell it is in, and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            cells, sizes_, pivot, link = batch.column(0).to_pylist(), [], [], []
            for i, sets in _sets_by_block(batch.column(2), sim.k):
                for r, s in enumerate(sets, i):
                    if held[0] != cells[r]:  # rows come in order of their cells
                        held = (cells[r], next(_sets_by_block(batch.column(3).slice(r, 1), sim.k))[1][0])
                    both = len(np.intersect1d(s, held[1], assume_unique=True))
                    sizes_.append(len(s))
                    pivot.append(len(held[1]))
                    link.append(sim.den * both >= sim.num * (len(s) + len(held[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes_, pa.int64()), pa.array(pivot, pa.int64()), pa.array(link, pa.bool_())], names=["cell", "node", "n", "pivot_n", "link"])

    one = pairs.join(texts.select("node", "text"), "node").select("cell", "node", "text")
    two = texts.select(F.col("node").alias("cell"), F.col("text").alias("pivot_text"))
    return one.join(two, "cell").select("cell", "node", "text", "pivot_text").mapInArrow(run, "cell long, node long, n long, pivot_n long, link boolean")


def classes(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id of those it reaches by links)."""
    docs = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    info = stored(sizes(docs, sim), "sizes")
    known = stored(info.where("sid is not null").groupBy("sid", "check").agg(F.min("doc_id").alias("node"), F.max("n").alias("n")), "sets")
    nodes = known.where("node is not null")
    pairs = slice_pivots(docs.where("doc_id is not null"), sim, frequent(docs, sim))
    # from hashes to the sets that have them; should two sets have one hash, both stand for it
    cells = stored(pairs.join(nodes.select("sid", "node"), "sid").join(nodes.select(F.col("sid").alias("pivot"), F.col("node").alias("cell")), "pivot").select("cell", "node"), "cells")
    links = _links(cells, _texts(docs, nodes, cells, sim), sim)
    joined = components(links).toDF("node", "component")
    known = known.join(joined, "node", "left").select("sid", "check", F.coalesce("component", "node").alias("component_id"))
    info = info.join(known, ["sid", "check"], "left")
    return info.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _texts(docs: DataFrame, nodes: DataFrame, cells: DataFrame, sim: Similarity) -> DataFrame:
    """node, n, text of the sets in cells. An id may stand for several sets: rows keep the text that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [set_id(s) if len(s) else (None, None) for _, sets in _sets_by_block(batch.column(2), sim.k) for s in sets]
            same = [a == b for a, b in zip(own, zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True), strict=True)]
            yield batch.select(["node", "n", "text"]).filter(pa.array(same, pa.bool_()))

    members = cells.select("node").union(cells.select(F.col("cell").alias("node"))).distinct()
    wanted = nodes.join(members, "node", "left_semi").withColumn("doc_id", F.col("node"))
    rows = docs.hint("merge").join(wanted, "doc_id").select("node", "n", "text", "sid", "check")
    return stored(rows.mapInArrow(run, "node long, n long, text string").dropDuplicates(["node"]), "texts")


def _links(cells: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """a, b: links that make the classes."""
    near = stored(measured(cells, texts, sim), "measured")
    links = near.where("link").select(F.col("cell").alias("a"), F.col("node").alias("b"))
    # a cell is settled if all its sets link with its pivot, or hold but one, whose distance is known
    whole = near.groupBy("cell").agg((F.count(F.lit(1)) + 1).alias("texts"), (F.sum("n") + F.max("pivot_n")).alias("shingles"), F.count_if(~F.col("link")).alias("apart"), F.max("pivot_n").alias("pivot_n"))
    whole = stored(whole.where("apart > 0 and texts > 2"), "open")
    own = whole.select("cell", F.col("cell").alias("node"), F.col("pivot_n").alias("n"), F.col("cell").alias("label"), "texts", "shingles")
    rows = near.select("cell", "node", "n", F.when(F.col("link"), F.col("cell")).otherwise(F.col("node")).alias("label")).join(whole.select("cell", "texts", "shingles"), "cell")
    rows = stored(rows.select(own.columns).union(own), "cells")
    while True:
        small = rows.where(~_big()).join(texts.select("node", "text"), "node")
        links = stored(links.union(join_groups(small, sim, ["cell"])), "links")
        rows = stored(rows.where(_big()), "large")
        if rows.isEmpty():
            return links
        made = stored(part(rows, texts, sim), "parted")
        links = stored(links.union(made.where("link").select(F.col("cell").alias("a"), F.col("node").alias("b"))), "links")
        # windows don't part a cell if a region has nearly all its sets or the regions hold twice as many
        regions = made.where("not link").groupBy("cell", "parent").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        was = rows.groupBy(F.col("cell").alias("parent")).agg(F.count(F.lit(1)).alias("was"))
        stuck = stored(regions.join(was, "parent").where("most > 0.8 * was or n > 2 * was").select("parent"), "stuck")
        dense = rows.join(stuck.select(F.col("parent").alias("cell")), "cell", "left_semi").select("cell", "node", "n")
        links = stored(links.union(dealt(_open(dense, links), texts, sim)), "links")
        rows = made.where("not link").join(stuck, "parent", "left_anti").select("cell", "node").join(texts.select("node", "n"), "node")
        rows = _open(rows, links)


def _big() -> Column:
    return (F.col("texts") > MOST_TEXTS) | (F.col("shingles") > MOST_SHINGLES)


def _open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """cell, node, n, label, texts, shingles of the cells that hold sets of more than one class."""
    rows = rows.select("cell", "node", "n").join(components(links).toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = stored(rows, "labelled")
    whole = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"), F.min("label").alias("x"), F.max("label").alias("y"))
    return stored(rows.join(stored(whole.where("x < y").drop("x", "y"), "open"), "cell"), "open")


def part(rows: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """One distributed Voronoi step: cell, node, link, parent. With link: the pivot `cell` links with the node. Else: the node is in the region `cell`."""
    chosen = rows.groupBy("cell").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("label", F.lit(j))) for j in range(PIVOTS)))).alias("pivots"))
    pivots = chosen.select("cell", F.explode("pivots").alias("node")).join(texts.select("node", "text"), "node")
    pivots = stored(pivots.groupBy("cell").agg(F.collect_list("node").alias("pivots"), F.collect_list("text").alias("pivot_texts")), "pivots")  # PIVOTS a cell
    salts = rows.groupBy("cell").agg(F.ceil(F.max("texts") / (MOST_TEXTS / 2)).cast("int").alias("salts"))
    pivots = stored(pivots.join(salts, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts"), "pivots")
    members = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("texts") / (MOST_TEXTS / 2))).cast("int"))
    members = members.join(texts.select("node", "text"), "node").select("cell", "salt", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, own = None, [], []
        for batch in batches:
            cells, nodes, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, sets in _sets_by_block(batch.column(2), sim.k):
                for r, s in enumerate(sets, i):
                    if held != cells[r]:
                        held, ids = cells[r], batch.column(3)[r].as_py()
                        own = [x for _, p in _sets_by_block(pa.array(batch.column(4)[r].as_py(), pa.large_string()), sim.k) for x in p]
                    both = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in own])
                    union = np.array([len(p) for p in own]) + len(s) - both
                    away = 1 - both / union
                    out += [(ids[j], nodes[r], True, held) for j in np.flatnonzero(sim.den * both >= sim.num * union).tolist()]
                    # the pivots of a cell and the cell name the region
                    out += [(int(mix(np.array([held, ids[j]], np.int64).astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64)), nodes[r], False, held) for j in np.flatnonzero(away <= away.min() + 2 * sim.eps + 1e-9).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["cell", "node", "link", "parent"])

    return members.join(pivots, ["cell", "salt"]).select("cell", "node", "text", "pivots", "pivot_texts").mapInArrow(run, "cell long, node long, link boolean, parent long")


def dealt(rows: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """Links in cells that windows don't part: sets outside the cell's largest class, in blocks, against all of the cell, in blocks."""
    counts = rows.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cell").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    size = F.ceil(F.greatest(F.col("texts") / (MOST_TEXTS // 2), F.col("shingles") / (MOST_SHINGLES // 2))).cast("int")
    rows = stored(rows.join(counts, "cell").withColumn("parts", size).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "dense")
    asked = rows.where("label <> main").select("cell", "block").distinct().withColumnRenamed("block", "query")
    queries = rows.where("label <> main").select("cell", "node", "label", F.col("block").alias("query"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    members = rows.select("cell", "node", "label", "block").join(asked, "cell").select("cell", "node", "label", "query", "block")
    return join_groups(queries.union(members).distinct().join(texts.select("node", "text"), "node"), sim, ["cell", "query", "block"])


def deduplicated(docs: DataFrame, sim: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of a class but its least id. Rows without an id stay; so do repeated rows of the one that stays.

    An id that stands for several texts goes only if each of them is in the class of a smaller id.
    """
    out = classes(docs, sim, id_col, text_col)
    drop = out.where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("last")).where("doc_id <> last").select(F.col("doc_id").alias("__gone"))
    return docs.join(drop, docs[id_col] == F.col("__gone"), "left_anti")
