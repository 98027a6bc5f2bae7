"""Exact near-duplicate embeddings by dual traversal of a cover tree.

Unit vectors at distance t or less are those with cosine 1 - t*t/2 or more. The tree's upper levels are tables: a node
with more vectors than a task should hold is split by centres of its own, the first of a farthest-first order of a
sample of it, until they cover the sample within half of the node's radius or the fan is full; all its vectors join
their nearest centre, and Spark measures each child's covering radius over all of them. The tree is traversed against
itself by joins, level by level: pairs of nodes that their radii keep apart are dropped, the others open into the pairs
of their children, down to pairs of leaves. Leaves are dealt to bins, and the leaf pairs between two bins are one task's
work, so a leaf is sent once for each bin that it meets and not once for each leaf; rounds keep what is sent at a time
near the size of all leaves. A pair descends the lower levels (nets of halving radii within a leaf) on both sides at
once: node pairs too far apart go, node pairs that are near as a whole count without looking at their vectors, and the
rest is compared in double precision. Tasks return counts and spanning edges, never pairs; nothing but a few counts
reaches the driver. A level's table of vectors goes as soon as the next one is written.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch
from ionlake.llm.graph import components

#: Vectors that a node's centres are chosen from, vectors that a leaf holds at most, children of a node at most, and vectors that one placing task gets.
SAMPLE, PART, FAN, BLOCK = 1024, 4096, 32, 16384
#: Levels that split by distance; below, nodes are dealt by number (vectors that many others surround within rounding).
DEEPEST = 24
#: Radii of the nets inside a leaf, from the top.
RADII = (0.5, 0.25, 0.125)
#: Bytes of leaves in a bin and bins of few leaves, what a round sends in sizes of all leaves, and bytes that it may send in any case.
BIN, BINS, SHIP, SHIP_BYTES = 8 << 20, 12, 1.5, 64 << 20
#: More than the rounding error of a distance computed from a dot product in single or double precision.
SLACK32, SLACK = 2e-3, 1e-7


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def farthest_first(units: np.ndarray, most: int, radius: float = 1e-6) -> np.ndarray:
    """Indices of the first centres; a prefix that ends where the next distance falls below r is an r-net."""
    chosen, away = [0], _distances(units, units[:1])[:, 0]
    while len(chosen) < min(most, len(units)) and away.max() > radius:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(units, units[chosen[-1:]])[:, 0])
    return np.array(chosen)


def net(units: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaders that are further than the radius from each other, and of each row its leader's position."""
    leaders: list[int] = []
    of = np.empty(len(units), dtype=np.int64)
    for start in range(0, len(units), 256):
        block = units[start : start + 256]
        best, near = np.full(len(block), np.inf), np.zeros(len(block), dtype=np.int64)
        if leaders:
            away = _distances(block, units[leaders])
            near, best = away.argmin(axis=1), away.min(axis=1)
        of[start : start + len(block)] = near
        late = np.flatnonzero(best > radius)
        among = _distances(block[late], block[late])
        taken = np.zeros(len(late), dtype=bool)
        for i in range(len(late)):
            if not taken[i]:
                mine = ~taken & (among[i] <= radius)
                mine[i] = True
                of[start + late[mine]] = len(leaders)
                leaders.append(start + int(late[i]))
                taken |= mine
    return np.array(leaders, dtype=np.int64), of


def nets_of(units: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The centres of each level, as rows, the coarsest first, and of each level below the first its rows' parents."""
    centres, parents = [np.arange(len(units))], []
    for radius in reversed(RADII):
        leaders, of = net(units[centres[0]], radius)
        parents.insert(0, of)
        centres.insert(0, centres[0][leaders])
    return centres, parents


class Side:
    """A part's vectors and the nodes of its levels, the coarsest first; the last level is the vectors."""

    def __init__(self, units: np.ndarray, ids: np.ndarray, copies: np.ndarray, nets: tuple | None = None) -> None:
        self.units, self.ids, self.copies = units, ids, copies
        self.centres, self.parents = nets or nets_of(units)
        self.radius, self.members, self.weight, self.children = [], [], [], []
        top = np.arange(len(units))
        for level in range(len(RADII), -1, -1):
            if level < len(RADII):
                top = self.parents[level][top]
            n = len(self.centres[level])
            away = np.zeros(n)
            np.maximum.at(away, top, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", units, units[self.centres[level][top]]))))
            order = np.argsort(top, kind="stable")
            self.members.insert(0, (order, np.searchsorted(top[order], np.arange(n + 1))))
            self.radius.insert(0, away if level < len(RADII) else np.zeros(n))
            self.weight.insert(0, np.bincount(top, copies, n))
        for parents in self.parents:
            order = np.argsort(parents, kind="stable")
            self.children.append((order, np.searchsorted(parents[order], np.arange(parents.max() + 2))))


def _expand(lists: tuple[np.ndarray, np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the lists ``of``, and for each the position in ``of`` it came from."""
    order, starts = lists
    sizes = starts[of + 1] - starts[of]
    at = np.repeat(np.arange(len(of)), sizes)
    return order[np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[of], sizes)], at


def joined(a: Side, b: Side, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of a, of b (vectors of one part: all of them in a), and edges that span the links."""
    same, limit = a is b, float(np.sqrt(2 - 2 * cosine))
    count_a, count_b = np.zeros(len(a.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def near(i: np.ndarray, j: np.ndarray, level: int) -> None:
        """Node pairs that are near as a whole."""
        both, where = _expand(a.members[level], i)
        np.add.at(count_a, both, b.weight[level][j[where]].astype(np.int64) - (a.copies[both] if same else 0) * (i == j)[where])
        edges.append((a.ids[both], b.ids[b.centres[level][j[where]]]))
        both, where = _expand(b.members[level], j)
        if not same:
            np.add.at(count_b, both, a.weight[level][i[where]].astype(np.int64))
        edges.append((b.ids[both], a.ids[a.centres[level][i[where]]]))

    def visit(i: np.ndarray, j: np.ndarray, level: int) -> None:
        last = level == len(RADII)
        for start in range(0, len(i), 1 << 16):
            x, y = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            if last and same:
                x, y = x[keep := x != y], y[keep]
            dots = np.einsum("ij,ij->i", a.units[a.centres[level][x]], b.units[b.centres[level][y]])
            if last:
                hit = dots >= cosine
                np.add.at(count_a, x[hit], b.copies[y[hit]])
                if not same:
                    np.add.at(count_b, y[hit], a.copies[x[hit]])
                edges.append((a.ids[x[hit]], b.ids[y[hit]]))
                continue
            away, wide = np.sqrt(np.maximum(0, 2 - 2 * dots)), a.radius[level][x] + b.radius[level][y]
            whole = away + wide <= limit - SLACK
            near(x[whole], y[whole], level)
            open_ones = ~whole & (away - wide <= limit + SLACK)
            below, where = _expand(a.children[level], x[open_ones])
            right, again = _expand(b.children[level], y[open_ones][where])
            visit(below[again], right, level + 1)

    top_b = b.units[b.centres[0]].astype(np.float32)
    for start in range(0, len(a.centres[0]), 1024):
        rows = a.units[a.centres[0][start : start + 1024]].astype(np.float32)
        reach = limit + SLACK32 + a.radius[0][start : start + 1024, None] + b.radius[0][None, :]
        i, j = np.nonzero(rows @ top_b.T >= 1 - np.minimum(2, reach) ** 2 / 2)
        visit(i + start, j, 0)
    ends = [np.concatenate(x) for x in zip(*edges, strict=True)] if edges else [np.zeros(0, np.int64)] * 2
    return count_a, count_b, *spanning(*ends)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of an edge list that aren't their smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, label = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]


def _normed(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two first brings each one's largest component near 1, so that no square over- or underflows."""
    raw = raw.astype(np.float64)
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _units(column: pd.Series) -> np.ndarray:
    return _normed(np.array(column.tolist(), dtype=np.float64))


def _built(single: bool):
    """A leaf as one row: its vectors as they are and its nets, found once for all the leaves that it meets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        raw = np.array(rows["embedding"].tolist(), dtype=np.float32 if single else np.float64)
        place = np.uint16 if len(raw) <= 1 << 16 else np.int64
        nets = tuple([x.astype(place) for x in level] for level in nets_of(_normed(raw)))
        leaf = (raw, rows["key"].to_numpy(), rows["copies"].to_numpy(), nets)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "leaf": [pickle.dumps(leaf, protocol=5)]})

    return run


def _read(blob: bytes) -> Side:
    raw, ids, copies, nets = pickle.loads(blob)
    return Side(_normed(raw), ids, copies, tuple([x.astype(np.int64) for x in level] for level in nets))


def _work(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The pairs of each leaf with its mates, leaves of the same task."""
        sides = {cell: _read(blob) for cell, blob in zip(group["cell"], group["leaf"], strict=True)}
        places = np.concatenate([x.ids for x in sides.values()])
        order = np.argsort(places, kind="stable")
        places, counts, ends = places[order], np.zeros(len(places), dtype=np.int64), []
        for cell, mates in zip(group["cell"], group["mates"], strict=True):
            for mate in mates:
                a, b = sides[cell], sides[mate]
                count_a, count_b, *edges = joined(a, b, cosine)
                counts[np.searchsorted(places, a.ids)] += count_a
                if a is not b:
                    counts[np.searchsorted(places, b.ids)] += count_b
                ends.append(edges)
        roots = places.copy()
        if ends:
            node, root = spanning(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            roots[np.searchsorted(places, node)] = root
        out = pd.DataFrame({"rep": places, "links": counts, "root": roots})
        return out[out["links"] > 0]

    return run


ROOT, LINKS = "r", "rep long, links long, root long"


def _split(part: int, fan: int):
    """Of one node's sample: the centres of its children, a single one if all are one point."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        units, n = _units(group["embedding"]), int(group["n"].iloc[0])
        chosen = farthest_first(units, min(fan, max(2, -(-2 * n // part))), max(1e-6, float(group["radius"].iloc[0]) / 2))
        if len(chosen) == 1 and _distances(units, units[:1]).max() > 1e-6:
            chosen = farthest_first(units, 2)
        alone = len(chosen) == 1
        return pd.DataFrame({"cell": group["cell"].iloc[0], "child": range(len(chosen)), "alone": alone, "centre": list(units[chosen])})

    return run


def _place(part: int):
    """A block of one node's vectors at their nearest child; dealt by number where the node has one centre."""

    def run(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres, rows = centres.sort_values("child"), rows.sort_values("key")
        if not len(rows):
            return pd.DataFrame({"key": [], "copies": [], "embedding": [], "cell": [], "away": []})
        away = _distances(_units(rows["embedding"]), np.array(centres["centre"].tolist()))
        child, off = away.argmin(axis=1).astype(str), away.min(axis=1)
        if bool(centres["alone"].iloc[0]) or int(rows["level"].iloc[0]) >= DEEPEST:
            parts = -(-int(rows["n"].iloc[0]) // part)
            child = [f"{c}.{k % parts}" for k, c in enumerate(child)]
        return pd.DataFrame({"key": rows["key"], "copies": rows["copies"], "embedding": rows["embedding"], "cell": [f"{c}/{k}" for c, k in zip(rows["cell"], child, strict=True)], "away": off})

    return run


def _tree(reps: DataFrame, at: str, scratch: Scratch) -> tuple[DataFrame, list[str], DataFrame | None]:
    """(key, copies, embedding, cell) with the leaf of each vector, the paths of its tables, and (parent, node, centre,
    radius) of all nodes below the root. The table of ``reps`` is at ``at``; a level's goes once the next one is there."""
    names = "key", "copies", "embedding", "cell"
    rows, radii, nodes, level = reps.withColumn("cell", F.lit(ROOT)).select(*names), None, None, 0
    leaves, held = None, []
    while True:
        sized = scratch.keep(rows.groupBy("cell").agg(F.count("*").alias("n")))
        big = sized.where(F.col("n") > PART)
        if not big.head(1):
            return rows if leaves is None else leaves.union(rows), [*held, at], nodes
        if sized.where(F.col("n") <= PART).head(1):
            fit, fit_at = scratch.write(rows.join(big.select("cell"), "cell", "left_anti").select(*names))
            leaves = fit if leaves is None else leaves.union(fit)
            held.append(fit_at)
        big = big.withColumn("radius", F.lit(2.0)) if radii is None else big.join(radii, "cell")
        open_rows = rows.join(big, "cell").withColumn("level", F.lit(level))
        sample = open_rows.where(F.pmod(F.xxhash64("key", "level"), F.col("n")) < SAMPLE)
        centres = scratch.keep(sample.groupBy("cell").applyInPandas(_split(PART, FAN), "cell string, child int, alone boolean, centre array<double>"))
        block = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).alias("block")
        blocks = big.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK).cast("long") - 1)).alias("block"))
        dealt = open_rows.select(*names, "n", "level", block)
        placed = dealt.groupBy("cell", "block").cogroup(centres.join(blocks, "cell").groupBy("cell", "block"))
        kind = reps.schema["embedding"].dataType.simpleString()
        rows, new = scratch.write(placed.applyInPandas(_place(PART), f"key long, copies long, embedding {kind}, cell string, away double"))
        scratch.drop(at)
        scratch.release()
        at = new
        radii = scratch.keep(rows.groupBy("cell").agg(F.max("away").alias("radius")))
        rows = rows.select(*names)
        parent, child = F.regexp_replace("cell", "/[^/]*$", ""), F.regexp_extract("cell", "/([0-9]+)[^/]*$", 1).cast("int")
        made = radii.select(parent.alias("parent"), F.col("cell").alias("node"), "radius", child.alias("child")).join(centres.select(F.col("cell").alias("parent"), "child", "centre"), ["parent", "child"])
        made = scratch.keep(made.select("parent", "node", "centre", "radius"))
        nodes = made if nodes is None else nodes.union(made)
        level += 1


def _leaf_pairs(nodes: DataFrame | None, limit: float, scratch: Scratch) -> DataFrame:
    """(a, b), a <= b: the pairs of leaves that may hold links, by traversing the tree against itself from the root."""
    now = scratch.spark.createDataFrame([(ROOT, ROOT)], "a string, b string")
    if nodes is None:
        return now
    inner = nodes.select(F.col("parent").alias("node")).distinct()
    ends = nodes.join(inner, "node", "left_anti").select(F.col("node").alias("parent"), "node", "centre", "radius", F.lit(True).alias("leaf"))
    kids = scratch.keep(nodes.join(inner, "node", "left_semi").select("parent", "node", "centre", "radius", F.lit(False).alias("leaf")).union(nodes.join(inner, "node", "left_anti").select("parent", "node", "centre", "radius", F.lit(True))).union(ends))
    one, other = (kids.select(F.col("parent").alias(f"p{k}"), F.col("node").alias(f"n{k}"), F.col("centre").alias(f"c{k}"), F.col("radius").alias(f"r{k}"), F.col("leaf").alias(f"l{k}")) for k in (0, 1))
    while True:
        met = now.join(one, F.col("a") == F.col("p0")).join(other, F.col("b") == F.col("p1")).where("a < b or n0 <= n1")
        away = F.sqrt(F.aggregate(F.zip_with("c0", "c1", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))
        near = met.where((F.col("n0") == F.col("n1")) | (away <= F.col("r0") + F.col("r1") + limit))
        now = scratch.keep(near.select(F.least("n0", "n1").alias("a"), F.greatest("n0", "n1").alias("b"), (F.col("l0") & F.col("l1")).alias("done")).distinct())
        if not now.where("not done").head(1):
            return now.select("a", "b")
        now = now.select("a", "b")


def _links_of(reps: DataFrame, at: str, cosine: float, scratch: Scratch, found: str) -> None:
    """Adds (rep, links, root) by task to the table at ``found``, for vectors (key, copies, embedding) of one dimension; rep
    and root are keys. The table of ``reps`` at ``at`` goes on the way."""
    rows, held, nodes = _tree(reps, at, scratch)
    single = reps.schema["embedding"].dataType.simpleString() == "array<float>"
    leaves = scratch.keep(rows.groupBy("cell").applyInPandas(_built(single), "cell string, leaf binary"))
    scratch.drop(*held)
    scratch.release()
    pairs = _leaf_pairs(nodes, float(np.sqrt(2 - 2 * cosine)) + SLACK, scratch)
    sizes = leaves.select("cell", F.length("leaf").alias("size"))
    n, size = sizes.agg(F.count("*"), F.sum("size")).first()
    one, other = (F.pmod(F.xxhash64(c), F.lit(max(min(BINS, n), size // BIN))) for c in "ab")
    tasks = pairs.select(F.concat_ws("|", F.least(one, other), F.greatest(one, other)).alias("task"), "a", "b")
    ends = tasks.select("task", F.col("a").alias("cell"), F.col("b").alias("mate")).union(tasks.select("task", "b", F.lit(None)))
    ends = scratch.keep(ends.groupBy("task", "cell").agg(F.collect_list("mate").alias("mates")))
    sent = ends.join(sizes, "cell").agg(F.sum("size")).first()[0]
    rounds = -(-sent // max(SHIP_BYTES, int(SHIP * size)))
    for k in range(rounds):
        #: A few leaves' names for each leaf.
        mine = F.broadcast(ends.where(F.pmod(F.xxhash64("task"), F.lit(rounds)) == k))
        met = leaves.join(mine, "cell").select("task", "cell", "mates", "leaf")
        met.groupBy("task").applyInPandas(_work(cosine), LINKS).write.mode("append").option("compression", "zstd").parquet(found)
        scratch.release()


def _sound(column: str):
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine in double precision is at least ``cosine`` (above 0). A vector that
    is null, empty or zero, or holds nulls or non-finite numbers, links with nothing; so do vectors of different
    lengths. Equal vectors are represented once and counted in full. Rows with a null id are kept and link with
    nothing. Rows that share an id are vectors of their own, each with its links and its component. The centres come
    from samples by hash, which fix the work's layout and not its result. An empty table gives an empty table; vectors
    may have any length. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    #: A column of floats stays one, as their cosines in double precision are the same; all others are doubles.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & _sound("embedding"), F.lit(False))
    sound = rows.where(usable)
    reps = sound.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps, reps_at = scratch.write(reps.withColumn("key", F.monotonically_increasing_id()))
    #: What the end needs of all rows, without their vectors.
    members = scratch.keep(sound.join(reps.select("embedding", "key"), "embedding").select("vec_id", "key"))
    known = scratch.keep(reps.select("key", "rep", "copies", F.size("embedding").alias("size")))
    scratch.release()
    found = f"{scratch.root}/links"
    sizes = [r["size"] for r in known.select("size").distinct().orderBy("size").collect()]
    for size in sizes:
        part, part_at = reps.select("key", "copies", "embedding"), reps_at
        if len(sizes) > 1:
            part, part_at = scratch.write(part.where(F.size("embedding") == size))
        _links_of(part, part_at, cosine, scratch, found)
    if len(sizes) > 1:
        scratch.drop(reps_at)
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), (F.col("vec_id") + 0).alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    found = scratch.spark.read.schema(LINKS).parquet(found)
    classes = scratch.keep(components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch).withColumnRenamed("node", "key"))
    least = classes.join(known.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("least"))
    counts = found.groupBy(F.col("rep").alias("key")).agg(F.sum("links").alias("links"))
    of_key = known.join(counts, "key", "left").join(classes.join(least, "component").select("key", "least"), "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component")
    )
    linked = members.join(of_key, "key").select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    return linked.union(alone)
