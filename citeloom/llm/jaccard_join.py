"""N-gram Jaccard join over count vectors, bounded in an R-tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm._common import connected_components, mark, release, small, stage

#: Least groups of a count vector, shingles of a group, points of a tree node, and shingles of a tree's points (of one that a pivot alone searches).
GROUPS, PER_GROUP, FANOUT, TREE_SHINGLES, STAR_SHINGLES = 32, 8, 8, 1 << 16, 1 << 13
#: One group in so many is spare, and dealings of a set into groups.
SPARE, DEALS = 6, 4
#: Least size of a size class as a share of its largest.
CLASS_WIDTH = 0.64

#: Rows that are made before they are handed on.
FLUSH_ROWS = 500

_CACHE_WORDS = 200_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``k``-word shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _ODD[i % 3] + w[i : i + n])
    return np.unique(h)


def size_tops(threshold: float, most: int) -> np.ndarray:
    """Largest size of each size class: a set and any that it may link with are in the same class or the next.

    A class spans as many factors of ``threshold`` as ``CLASS_WIDTH`` allows, so
    that few sets reach into the next one.
    """
    factor = threshold
    while factor * threshold >= CLASS_WIDTH:
        factor *= threshold
    tops = [int(1 / (1 - threshold) + 1e-9) - 1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, int(tops[-1] / factor + 1e-9)))
    return np.asarray(tops)


def groups_at(level: int, tops: np.ndarray, threshold: float) -> tuple[int, int]:
    """Groups of a level, and how many of them are the same in two linked sets beyond the first."""
    apart = int(2 * tops[level] * (1 - threshold) / (1 + threshold) + 1e-9)
    spare = -(-(apart + 1) // SPARE)
    return (apart + 1 + spare, spare) if apart else (0, 0)


def group_keys(h: np.ndarray, threshold: float, tops: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Lists of keys of a set, each with its slack: two linked sets share more keys of a list than either's slack.

    A level stands for two neighbouring size classes; linked sets meet at the
    level of the larger one. They differ in at most K shingles there, so of
    K + 1 + s groups of shingles 1 + s are the same in both. A key is the hash of
    level, dealing, group and the group's content; empty groups have none. With e
    empty groups more than s - e keys of a list are shared (its slack), if e is at
    most s. Otherwise the set is dealt into groups anew, up to ``DEALS`` times;
    of two sets the smaller number of dealings has the shared keys. A set for
    which all fail has the empty groups' keys, too, and a slack under 0.
    """
    n, own = len(h), int(np.searchsorted(tops, len(h)))
    out = []
    for level in (own, own + 1):
        n_groups, spare = groups_at(level, tops, threshold)
        other = n / threshold + 1e-9
        if n == 0 or not n_groups or (level > own and other <= tops[own]):
            continue
        apart = int((n + min(other, tops[level])) * (1 - threshold) / (1 + threshold) + 1e-9)
        used = min(n_groups, apart + 1 + spare)
        first_keys = None
        for deal in range(DEALS):
            x = h if not deal else np.sort(_mixed(h + np.uint64(deal)))
            first = np.searchsorted(((x >> np.uint64(32)) * np.uint64(n_groups)) >> np.uint64(32), np.arange(used + 1, dtype=np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(x + np.uint64(level)), dtype=np.uint64)])
            tag = np.uint64((level * DEALS + deal) << 32) + np.arange(used, dtype=np.uint64)
            keys = _mixed((sums[first[1:]] - sums[first[:-1]]) * _ODD[0] + _mixed(tag))
            held = first[1:] > first[:-1]
            empty = int(used - held.sum())
            if first_keys is None:
                first_keys = keys
            out.append((spare - empty, keys[held]))
            if empty <= spare:
                break
        else:
            out[-DEALS] = (-1, first_keys)
    return out


def counts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Group counts of sets: their points in the tree. Groups grow with the largest set, so that few unlike sets pass the bound."""
    sizes = np.diff(offsets)
    groups = GROUPS
    while groups * PER_GROUP < sizes.max(initial=0):
        groups *= 2
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = row * groups + (values.view(np.uint64) & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(sizes) * groups).reshape(len(sizes), groups).astype(np.uint16)


class CountTree:
    """R-tree over count vectors. A node's bound on the overlap with a query is the
    sum over coordinates of the lesser of the query's and the node's greatest."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = self._tiled(np.arange(len(points))) if len(points) > 8 * FANOUT else np.arange(len(points))
        nodes = [order[i : i + FANOUT] for i in range(0, len(order), FANOUT)]
        self.leaves = nodes
        self.tops = [np.stack([points[x].max(0) for x in nodes])] if nodes else [points[:0]]
        self.least = [np.asarray([sizes[x].min() for x in nodes])]
        while len(self.tops[-1]) > FANOUT:
            cuts = range(0, len(self.tops[-1]), FANOUT)
            self.tops.append(np.stack([self.tops[-1][i : i + FANOUT].max(0) for i in cuts]))
            self.least.append(np.asarray([self.least[-1][i : i + FANOUT].min() for i in cuts]))

    def _tiled(self, at: np.ndarray) -> np.ndarray:
        """Points by recursive halving on the coordinate of the widest spread."""
        if len(at) <= FANOUT:
            return at
        part = self.points[at]
        axis = int((part.max(0) - part.min(0)).argmax())
        at = at[np.argsort(part[:, axis], kind="stable")]
        half = (len(at) // 2 + FANOUT - 1) // FANOUT * FANOUT
        half = min(half, len(at) - 1)
        return np.concatenate([self._tiled(at[:half]), self._tiled(at[half:])])

    def near(self, point: np.ndarray, size: int, ratio: float) -> np.ndarray:
        """Points whose overlap with the query may reach ``ratio`` times the sum of sizes."""
        at = np.arange(len(self.tops[-1]))
        for depth in range(len(self.tops) - 1, -1, -1):
            tops, least = self.tops[depth], self.least[depth]
            at = at[at < len(tops)]
            fits = np.minimum(tops[at], point).sum(1, dtype=np.int64) >= ratio * (size + least[at]) - 1e-6
            at = at[fits]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        if not len(at):
            return at
        found = np.concatenate([self.leaves[i] for i in at])
        fits = np.minimum(self.points[found], point).sum(1, dtype=np.int64) >= ratio * (size + self.sizes[found]) - 1e-6
        return found[fits]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def cell_links(comp: np.ndarray, is_point: np.ndarray, is_query: np.ndarray, values: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of a cell's queries to its points, but those within a component that earlier ones have made."""
    ratio, out = threshold / (1 + threshold), []
    points, sizes = counts(values, offsets), np.diff(offsets)
    sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    at_points, comp = np.flatnonzero(is_point), comp.copy()
    tree = CountTree(points[at_points], sizes[at_points])
    for q in np.flatnonzero(is_query):
        for p in at_points[tree.near(points[q], int(sizes[q]), ratio)]:
            if comp[q] == comp[p]:
                continue
            both = overlap(sets[q], sets[p])
            if both >= threshold * (sizes[q] + sizes[p] - both) - 1e-9:
                low, high = sorted((int(comp[q]), int(comp[p])))
                out.append((high, low))
                comp[comp == high] = low
    return out


def _search(threshold: float):
    """Cells in order, as Arrow batches (cell columns, comp, is_point, is_query, sh), to links (a, b)."""

    def links(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        table = pa.Table.from_batches(rows).combine_chunks()
        sets = table.column("sh").combine_chunks()
        offsets = sets.offsets.to_numpy().astype(np.int64)
        flags = [table.column(c).to_numpy() for c in ("comp", "is_point", "is_query")]
        values = sets.values.to_numpy()[offsets[0] : offsets[-1]]
        return cell_links(*flags, values.view(np.uint64), offsets - offsets[0], threshold)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell, out = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(c).to_numpy() for c in ("pivot", "band", "tile", "turn")])
            edges = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                own = tuple(cells[:, a])
                if own != cell and held:
                    out += links(held)
                    held = []
                cell = own
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if held and (out := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return search


def _digests(h: np.ndarray) -> tuple[int, int, int]:
    return len(h), int(h.sum(dtype=np.uint64).astype(np.int64)), int(_mixed(h + _ODD[1]).sum(dtype=np.uint64).astype(np.int64))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, h1, h2`` and the sorted shingles ``sh``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH_ROWS):
                some = batch.slice(at, FLUSH_ROWS)
                sets = [shingles(text.as_py(), k) for text in some.column(1)]
                digests = [pa.array(x, pa.int64()) for x in zip(*map(_digests, sets), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *digests, _lists(sets)], names=["doc_id", "n", "h1", "h2", "sh"])

    return docs.mapInArrow(make, "doc_id long, n long, h1 long, h2 long, sh array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))


def _keyed(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``doc_id, n, h1, h2, part, slack, keys``: a row for each list of keys of a text, and one at least (part 0)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = size_tops(threshold, 1 << 16)
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH_ROWS):
                rows, arrays = [], []
                for doc_id, text in zip(*[c.slice(at, FLUSH_ROWS) for c in batch.columns], strict=True):
                    h = shingles(text.as_py(), k)
                    while len(h) > tops[-2]:
                        tops = size_tops(threshold, 2 * int(tops[-1]))
                    digests = doc_id.as_py(), *_digests(h)
                    for part, (slack, keys) in enumerate(group_keys(h, threshold, tops) or [(0, h[:0])]):
                        rows.append((*digests, part, slack))
                        arrays.append(keys)
                if rows:
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, _lists(arrays)], names=["doc_id", "n", "h1", "h2", "part", "slack", "keys"])

    return docs.mapInArrow(make, "doc_id long, n long, h1 long, h2 long, part int, slack int, keys array<long>")


def jaccard_components(docs: DataFrame, *, k: int = 3, threshold: float = 0.9) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets.

    Returns ``doc_id, n_shingles, component_id`` for every row of ``docs``. Two
    texts link when the intersection is at least ``threshold`` times the union;
    ``component_id`` is the smallest doc_id that links reach.

    1. Equal sets become one class, represented by its smallest doc_id.
    2. Linked sets share the whole content of some groups of shingles (see
       ``group_keys``), which deals them to blocks: those that share a key with
       a pivot, the smallest id of the key. As linked sets share more keys than
       the slack, a set drops as many of its keys as that, the commonest of all
       keys first; the rarest shared key is dropped by neither. So a passage
       that many documents have makes no block, and a set that shares no more
       keys than its slack is done.
    3. A block's count vectors are indexed in R-trees of at most
       ``TREE_SHINGLES`` shingles, by bands of size where it needs several. The
       pivots are searched first: this links copies of a text by stars, whatever
       their number. Then what is not in its pivot's component is searched in the
       trees of the block; pairs whose bound by summed minima is enough are
       verified on the sets. Only links between different components are
       emitted, so no group's pairs are all made and no link is lost that would
       join components.

    Null or empty texts have the empty set and link with nothing. Rows with a
    null id have a null component and are not linked. Rows that repeat an id are
    rows of their own; if their texts differ, both stand for that id. No rows
    give no rows. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = stage(_keyed(own, k, threshold), "lists")
    rows = lists.where("part = 0").select("doc_id", "n", "h1", "h2")
    since = mark()
    classes = stage(
        rows.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    reps = classes.select("n", "h1", "h2", "rep")
    copies = stage(classes.where("copies > 1").select("n", "h1", "h2", "rep"), "copies")
    keyed = lists.where("doc_id is not null and size(keys) > 0").join(small(copies, copies.count(), 48), ["n", "h1", "h2"], "left")
    keyed = keyed.where("rep is null or rep = doc_id").select("doc_id", "part", "slack", F.explode("keys").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pivots = stage(pivots, "pivots").hint("merge")
    shared = keyed.join(pivots, "key").groupBy("doc_id", "part", "slack").agg(F.array_sort(F.collect_list(F.struct("size", "key", "pivot"))).alias("met"))
    kept = F.slice("met", F.lit(1), F.greatest(F.size("met") - F.greatest("slack", F.lit(0)), F.lit(0)))
    met = shared.select("doc_id", F.explode(kept["pivot"]).alias("pivot")).where("doc_id <> pivot")
    met = stage(met.groupBy("doc_id", "pivot").agg(F.count(F.lit(1)).alias("shared")), "met")
    nodes = stage(met.select("doc_id").union(met.select("pivot")).distinct(), "nodes")
    n_nodes = nodes.count()
    if n_nodes:
        sets = _candidate_sets(own, rows, nodes, n_nodes, reps, k)
        linked = _star_links(met, sets, threshold)
        stars = stage(connected_components(linked), "stars")
        more = stage(_astray_links(met, nodes, stars, sets, threshold), "more")
        merged = stage(connected_components(more), "merged")
        component = stars.join(merged.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select(
            "node", F.coalesce("joined", "component").alias("component")
        )
        alone = merged.join(stars, "node", "left_anti").select("node", "component")
        component = component.union(alone).withColumnRenamed("node", "rep")
        classes = classes.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        classes = classes.withColumn("component", F.col("rep"))
    moved = stage(classes.where("copies > 1 or component <> rep").select("n", "h1", "h2", "component"), "moved")
    release(since, moved)
    return rows.join(small(moved, moved.count(), 48), ["n", "h1", "h2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def _candidate_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, n_nodes: int, reps: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, sh`` of the representatives that share a key with another.

    Only where an id repeats are its texts told apart by their digests.
    """
    texts = docs.join(small(nodes, n_nodes, 16), "doc_id", "left_semi")
    sets = _sets(texts, k)
    if rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        same = reps.select(F.col("rep").alias("doc_id"), "n", "h1", "h2")
        sets = sets.join(same, ["doc_id", "n", "h1", "h2"], "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("n", "sh"), F.struct("n", "h1", "h2")).alias("x"))
        sets = sets.select("doc_id", "x.*")
    return stage(sets.select("doc_id", "n", "sh"), "candidates")


def _star_links(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links to the pivot that a document shares most keys with; the pivots are the queries."""
    best = met.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("pivot")).alias("minus"))).alias("x")).select("doc_id", (-F.col("x.minus")).alias("pivot"))
    members = best.join(sets.select("doc_id", "n"), "doc_id").select("pivot", "doc_id", F.col("doc_id").alias("comp"), "n")
    queries = best.select("pivot").distinct().join(sets.select(F.col("doc_id").alias("pivot"), "n"), "pivot")
    queries = queries.select("pivot", F.col("pivot").alias("doc_id"), F.col("pivot").alias("comp"), "n")
    return _tree_links(members, queries, sets, threshold, STAR_SHINGLES)


def _astray_links(met: DataFrame, nodes: DataFrame, stars: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between components: what isn't in its pivot's component against the pivot's block."""
    comp = nodes.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"))
    members = met.select("doc_id", "pivot").union(met.select(F.col("pivot").alias("doc_id"), "pivot").distinct()).join(comp, "doc_id")
    members = members.join(comp.select(F.col("doc_id").alias("pivot"), F.col("comp").alias("home")), "pivot").join(sets.select("doc_id", "n"), "doc_id")
    members = members.select("pivot", "doc_id", "comp", "n", (F.col("comp") != F.col("home")).alias("astray"))
    members = stage(members, "members")
    # a block of two has been searched from its pivot, unless the pivot was not the best one of the other
    blocks = members.groupBy("pivot").agg(F.count_if("astray").alias("queries")).where("queries > 0").select("pivot")
    # written, so that the join reads two shuffles and can split a large block
    blocks = stage(blocks, "blocks").hint("merge")
    members = members.join(blocks, "pivot", "left_semi")
    return _tree_links(members.drop("astray"), members.where("astray").drop("astray"), sets, threshold, TREE_SHINGLES)


def _tree_links(members: DataFrame, queries: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """Search the R-trees of blocks: ``members`` and ``queries`` have ``pivot, doc_id, comp, n``.

    Where a block has more shingles than a tree may hold (``most``), its members are dealt
    to bands of size (two to a factor of ``threshold``: links reach two bands
    up or down), and a band to trees; as many queries meet a tree in a turn.
    """
    spark = members.sparkSession
    members = stage(members, "points")
    width = -0.5 * float(np.log(threshold))
    weights = members.groupBy("pivot").agg(F.sum("n").alias("weight"))
    large = stage(weights.where(F.col("weight") > most).select("pivot"), "large")
    n_large = large.count()

    def banded(df: DataFrame) -> DataFrame:
        found = df.join(small(large.withColumn("split", F.lit(True)), n_large, 16), "pivot", "left") if n_large else df.withColumn("split", F.lit(None).cast("boolean"))
        return found.withColumn("band", F.when(F.col("split"), F.floor(F.ln(F.greatest("n", F.lit(1))) / width).cast("int")).otherwise(F.lit(-1))).drop("split")

    points, asked = banded(members), banded(queries)
    parts = lambda n: F.greatest(F.ceil(F.sum(n) / most), F.lit(1)).cast("int")
    if n_large:
        near = F.when(F.col("band") < 0, F.array("band")).otherwise(F.sequence(F.greatest(F.col("band") - 2, F.lit(0)), F.col("band") + 2))
        asked = asked.withColumn("band", F.explode(near))
        trees = points.where("band >= 0").groupBy("pivot", "band").agg(parts("n").alias("trees"))
        turns = asked.where("band >= 0").groupBy("pivot", "band").agg(parts("n").alias("turns"))
        directory = stage(trees.join(turns, ["pivot", "band"]), "directory")
        directory = small(directory, directory.count(), 32)
        whole = F.struct(F.lit(1).alias("trees"), F.lit(1).alias("turns"))

        def dealt(df: DataFrame) -> DataFrame:
            # a band that nothing is looked for in, or that is empty, has no cell
            found = df.join(directory, ["pivot", "band"], "left").where("band < 0 or trees is not null")
            return found.withColumns({c: F.coalesce(c, whole[c]) for c in ("trees", "turns")})

        points, asked = dealt(points), dealt(asked)
    else:
        ones = {"trees": F.lit(1), "turns": F.lit(1)}
        points, asked = points.withColumns(ones), asked.withColumns(ones)
    share = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["pivot", "band", "tile", "turn"]
    points = points.withColumn("tile", share(0, "trees")).select("*", every("turns").alias("turn"), F.lit(True).alias("is_point"), F.lit(False).alias("is_query"))
    asked = asked.withColumn("turn", share(1, "turns")).select("*", every("trees").alias("tile"), F.lit(False).alias("is_point"), F.lit(True).alias("is_query"))
    columns = [*cell, "doc_id", "comp", "is_point", "is_query"]
    placed = points.select(*columns).unionByName(asked.select(*columns)).join(sets.select("doc_id", "sh"), "doc_id").drop("doc_id")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(members.agg(F.sum("n")).first()[0] or 0) // (8 << 18)))
    placed = placed.withColumns({c: F.col(c).cast("long") for c in cell}).repartition(n_parts, *cell).sortWithinPartitions(*cell)
    return placed.mapInArrow(_search(threshold), "a long, b long").distinct()


def keep_one(docs: DataFrame, *, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the component's.

    Rows with a null id stay; of an id that repeats, all rows stay or go together.
    """
    found = jaccard_components(docs, k=k, threshold=threshold).where("doc_id is not null")
    gone = stage(found.groupBy("doc_id").agg(F.min(F.col("component_id") != F.col("doc_id")).alias("gone")).where("gone").select("doc_id"), "near")
    return docs.join(small(gone, gone.count(), 16), "doc_id", "left_anti").select(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS sh
  FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(sh)
"""
