"""Near-duplicate embeddings by a subspace pigeonhole join (op9).

Vectors of one label are linked when their cosine, in double precision, is ``threshold`` or more. Of unit vectors
that means a squared distance of 2 - 2 * threshold at most.

* Equal vectors of a label are one class, met once in the search and counted with its size.
* Unit vectors are turned by a fixed random rotation and split into blocks. If the whole
  squared distance is within budget, at least one block's is within the share of the budget that is
  proportional to the block's dimensions: the pigeonholes lose no pair.
* Each block is range-joined. A label that fits a task (``CELL_VALUES``) is one cell; a larger one is cut by a
  grid over as many of the block's coordinates as it needs, and a class visits the cells within the
  block's radius (of two cells only one side visits the other). What is still too large is cut into chunks, and
  every pair of chunks is a task's work of its own, so a cell is never gathered whole and no pair is lost.
* Within a cell the coordinates are cut into narrow steps and sorted, so that equal beginnings form a tree. Every class
  descends it, one coordinate a level, and leaves a branch as soon as the least squared distance to it
  passes the share: only what is left at the bottom has its block distance computed.
* Candidates are verified exactly on the original vectors where they are found. A pair found in several blocks
  counts in the first of them. Links leave the cell as counts and a forest, never as pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and one
with a null label, links with nothing, its component is its own id; vectors of other lengths than the
compared one never link; ids that repeat are told apart by their vectors and share the smallest
component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.98
BLOCK_DIMS = 16
#: Components of all vectors that a cell may hold before it is cut.
CELL_VALUES = 1 << 20
#: Width of a grid cell and of a tree's step, in radii of the block.
GRID_STEP, TREE_STEP = 2.0, 1.0
#: A cut by one more coordinate makes the largest cell smaller by this factor at least, as a rule.
GRID_CUT = 2.0
#: Paths down the tree that are held at once.
PATHS = 1 << 18
SEED = 20_260
#: Added to every share of the budget, against rounding in the rotation.
SLACK = 1e-6


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def shares(threshold: float, dims: int) -> np.ndarray:
    """The squared distance that is each block's part of the budget."""
    return np.array([(2 - 2 * threshold) * (b - a) / dims + SLACK for a, b in blocks_of(dims)])


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated space.

    Summed column by column, so that a vector gives the same bits in every task, whatever else is in its batch.
    """
    # Scaled first, so that squares neither overflow nor vanish.
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    norm = np.zeros(len(x))
    for k in range(x.shape[1]):
        norm += x[:, k] * x[:, k]
    x /= np.sqrt(norm)[:, None]
    by = rotation(x.shape[1])
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k, None] * by[:, k]
    return out


def _stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sound(vectors: DataFrame):
    """Whether a row can link at all."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        F.col("label").isNotNull() & ~broken & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )


def visits(own: np.ndarray, width: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every grid cell within the share of each row; the row's own cell comes first.

    Of two different cells that reach each other only the side with the lesser cell visits.
    """
    home = np.floor(own / width).astype(np.int64)
    row, cell = np.arange(len(own)), np.zeros((len(own), 0), dtype=np.int64)
    cost, ahead = np.zeros(len(own)), np.zeros(len(own), dtype=bool)
    for k in range(own.shape[1]):
        parts = []
        for move in (0, 1, -1):
            # Until a cell differs from home, the first step may only go up.
            let = ahead if move < 0 else np.ones(len(row), dtype=bool)
            at = home[row, k] + move
            gap = np.maximum(0, np.maximum(at * width - own[row, k], own[row, k] - (at + 1) * width))
            let = let & (cost + gap * gap <= share)
            parts.append((row[let], np.column_stack([cell[let], at[let]]), (cost + gap * gap)[let], (ahead | (move > 0))[let]))
        row, cell, cost, ahead = (np.concatenate(p) for p in zip(*parts, strict=True))
    return row, cell


def _cells(threshold: float, carry: bool):
    """(key, label, size, cuts, embedding) -> the cells of each block that a class is in or visits.

    Without ``carry`` the cells alone, to be counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            cuts = batch.column("cuts").to_numpy()
            for dims, cut in sorted(set(zip(lengths.tolist(), cuts.tolist(), strict=True))):
                rows = np.flatnonzero((lengths == dims) & (cuts == cut))
                for k in range(0, len(rows), max(1, (1 << 19) // dims)):
                    part = batch.take(pa.array(rows[k : k + max(1, (1 << 19) // dims)]))
                    x = turned(_stacked(part.column("embedding")))
                    for number, (block, share) in enumerate(zip(blocks_of(dims), shares(threshold, dims), strict=True)):
                        own = x[:, block[0] : min(block[0] + cut, block[1])]
                        row, cell = visits(own, GRID_STEP * np.sqrt(share), share)
                        visitor = np.arange(len(row)) >= len(own)
                        columns = {
                            "label": part.column("label").take(pa.array(row)),
                            "dims": pa.array(np.full(len(row), dims, np.int32)),
                            "block": pa.array(np.full(len(row), number, np.int32)),
                            "cell": pa.array([c.tobytes() for c in cell.astype(np.int32)], pa.binary()),
                        }
                        if carry:
                            columns |= {
                                "visitor": pa.array(visitor),
                                "key": part.column("key").take(pa.array(row)),
                                "size": part.column("size").take(pa.array(row)),
                                "embedding": part.column("embedding").take(pa.array(row)),
                            }
                        yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


class Tree:
    """Points sorted by their coordinates in narrow steps; equal beginnings are nodes."""

    def __init__(self, points: np.ndarray, share: float):
        self.width, self.share = TREE_STEP * np.sqrt(share), share
        steps = np.floor(points / self.width).astype(np.int32)
        self.order = np.lexsort(steps.T[::-1])
        self.points, steps = points[self.order], steps[self.order]
        #: By level: number of each point's node, and first point of each node.
        self.node, self.first, self.step = [], [], []
        differs = np.zeros(len(points), dtype=bool)
        differs[:1] = True
        for k in range(points.shape[1]):
            differs[1:] |= steps[1:, k] != steps[:-1, k]
            self.node.append(np.cumsum(differs) - 1)
            first = np.flatnonzero(differs)
            self.first.append(np.append(first, len(points)))
            self.step.append(steps[first, k])

    def near(self, queries: np.ndarray, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(query, point, nodes seen) of all pairs whose block distance is within the share.

        With ``after``, only points at later places of the order than given for each query.
        """
        waiting = [(np.arange(k, min(k + 4_096, len(queries))), None, None, 0) for k in range(0, len(queries), 4_096)][::-1]
        seen = 0
        while waiting:
            row, node, cost, level = waiting.pop()
            if level == len(self.node):
                begin, end = self.first[-1][node], self.first[-1][node + 1]
                many = end - begin
                i = np.repeat(row, many)
                j = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                if after is not None:
                    let = j > after[i]
                    i, j = i[let], j[let]
                yield i, j, seen
                seen = 0
                continue
            if node is None:
                low, high = np.zeros(len(row), np.int64), np.full(len(row), len(self.step[0]))
                cost = np.zeros(len(row))
            else:
                low = self.node[level][self.first[level - 1][node]]
                high = self.node[level][self.first[level - 1][node + 1] - 1] + 1
            # A piece of the paths at a time, so that their children fit.
            many = np.cumsum(high - low)
            cut = int(np.searchsorted(many, PATHS, side="right"))
            if 0 < cut < len(row):
                waiting.append((row[cut:], None if node is None else node[cut:], cost[cut:], level))
                row, cost, low, high = row[:cut], cost[:cut], low[:cut], high[:cut]
            many = high - low
            child = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            row, cost = np.repeat(row, many), np.repeat(cost, many)
            at = self.step[level][child] * self.width
            own = queries[row, level]
            gap = np.maximum(0, np.maximum(at - own, own - at - self.width))
            cost = cost + gap * gap
            let = cost <= self.share + SLACK
            if after is not None:
                let &= self.first[level][child + 1] - 1 > after[row]
            seen += len(child)
            if let.any():
                waiting.append((row[let], child[let], cost[let], level + 1))


def block_distances(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distance of each block, a row per pair; the same bits wherever a pair is met, either way round."""
    d = x[i] - x[j]
    d *= d
    out = np.zeros((len(i), len(blocks_of(x.shape[1]))))
    for number, (a, b) in enumerate(blocks_of(x.shape[1])):
        for k in range(a, b):
            out[:, number] += d[:, k]
    return out


class Links:
    """Links of the rows of one cell: how many documents each meets, and a forest of them."""

    def __init__(self, vectors: np.ndarray, block: int, threshold: float):
        self.vectors, self.block, self.threshold = vectors, block, threshold
        self.share = shares(threshold, vectors.shape[1])
        self.x = turned(vectors)
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        a, b = blocks_of(vectors.shape[1])[block]
        self.own = self.x[:, a:b]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.root = np.arange(len(vectors))
        self.nodes = self.distances = 0

    def add(self, i: np.ndarray, j: np.ndarray, size: np.ndarray, met: np.ndarray) -> None:
        """Verify candidates; those whose first block within its share is this one count here."""
        for k in range(0, len(i), 65_536):
            a, b = i[k : k + 65_536], j[k : k + 65_536]
            self.distances += len(a)
            within = block_distances(self.x, a, b) <= self.share
            let = within[:, self.block] & ~within[:, : self.block].any(axis=1)
            a, b = a[let], b[let]
            cosine = np.einsum("ij,ij->i", self.vectors[a], self.vectors[b]) / (self.norms[a] * self.norms[b])
            a, b = a[cosine >= self.threshold], b[cosine >= self.threshold]
            np.add.at(met, a, size[b])
            np.add.at(met, b, size[a])
            self._hang(a, b)

    def _hang(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of linked rows; roots are the least rows."""
        while True:
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            high, low = np.maximum(self.root[a], self.root[b]), np.minimum(self.root[a], self.root[b])
            if (high == low).all():
                return
            np.minimum.at(self.root, high, low)

    def join(self, targets: np.ndarray, queries: np.ndarray, itself: bool, size: np.ndarray, met: np.ndarray) -> None:
        """Pairs of two sets of rows, or of one with itself."""
        if not len(targets) or not len(queries):
            return
        tree = Tree(self.own[targets], self.share[self.block])
        place = None
        if itself:
            place = np.empty(len(targets), dtype=np.int64)
            place[tree.order] = np.arange(len(targets))
        for i, j, nodes in tree.near(self.own[queries], place):
            self.nodes += nodes
            self.add(queries[i], targets[tree.order[j]], size, met)


def _linked(threshold: float):
    """A group of (label, dims, block, cell, chunks): by class, documents linked and a root of its forest."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, low, high = key[2].as_py(), key[4].as_py(), key[5].as_py()
        keys, size = table.column("key").to_numpy(), table.column("size").to_numpy()
        visitor = table.column("visitor").to_numpy(zero_copy_only=False)
        chunk = table.column("chunk").to_numpy()
        links = Links(_stacked(table.column("embedding").combine_chunks()), block, threshold)
        met = np.zeros(len(keys), dtype=np.int64)
        rows = np.flatnonzero
        if low == high:
            home = rows(~visitor)
            links.join(home, home, True, size, met)
            links.join(home, rows(visitor), False, size, met)
        else:
            links.join(rows(~visitor & (chunk == low)), rows(chunk == high), False, size, met)
            links.join(rows(~visitor & (chunk == high)), rows(visitor & (chunk == low)), False, size, met)
        let = met > 0
        return pa.table(
            {
                "key": pa.array(keys[let]),
                "links": pa.array(met[let]),
                "root": pa.array(keys[links.root[let]]),
            }
        )

    return run


def links_of(reps: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) of the ``reps`` (key, label, size, embedding) that link, once for each cell where they do."""
    dims = F.size("embedding")
    counts = reps.groupBy("label", dims.alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    # Rows of a length that a task takes at once.
    room = F.greatest(F.lit(1), F.floor(F.lit(CELL_VALUES) / F.col("dims")))
    cuts = F.ceil(F.log(F.col("n") / room) / float(np.log(GRID_CUT)))
    counts = counts.select("label", "dims", F.greatest(F.lit(0), F.least(cuts, F.lit(BLOCK_DIMS))).cast("int").alias("cuts"))
    rows = reps.withColumn("dims", dims).join(counts, ["label", "dims"]).select("key", "label", "size", "cuts", "embedding")
    rows = common.staged(rows, "embedding-rows")
    place = ["label", "dims", "block", "cell"]
    kinds = "label long, dims int, block int, cell binary"
    # Cells are counted first, without their vectors; only those too large for a task come back.
    large = rows.mapInArrow(_cells(threshold, False), kinds).groupBy(place).agg(F.count(F.lit(1)).alias("n"))
    large = large.where(F.col("n") > room).select(*place, F.ceil(F.col("n") / room).cast("int").alias("chunks"))
    cells = rows.mapInArrow(_cells(threshold, True), kinds + ", visitor boolean, key long, size long, embedding array<float>")
    cells = cells.join(common.staged(large, "embedding-cells"), place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cells = cells.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    group = [*place, "low", "high"]
    # By all of the group, so that the chunks of one cell spread over the tasks.
    cells = cells.repartition(*group)
    return cells.groupBy(group).applyInArrow(_linked(threshold), "key long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", "embedding", sound(vectors).alias("sound"))
    rows = rows.withColumn("hash", F.xxhash64("label", "embedding"))
    same = ["hash", "label", "embedding"]
    reps = rows.where("sound").groupBy(same).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    # A number of its own for each class, fixed by being written: ids may repeat.
    reps = common.staged(reps.withColumn("key", F.monotonically_increasing_id()), "embedding-classes")
    links = links_of(reps.select("key", F.col("label").cast("long").alias("label"), "size", "embedding"), threshold)
    links = common.staged(links, "embedding-links")
    met = links.groupBy("key").agg(F.sum("links").alias("n"))
    group = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), "embeddings").withColumnRenamed("id", "key")
    by_class = reps.join(met, "key", "left").join(group, "key", "left")
    by_class = by_class.withColumn("component", F.coalesce("component", "key"))
    least = by_class.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = by_class.join(least, "component").select(
        *same, (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id"
    )
    linked = rows.where("sound").join(by_class, same).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98, and which of them are kept."""
    vectors = common.only(common.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    found = near_duplicates(vectors)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE sound),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v
  UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.id LEFT JOIN k ON v.vec_id = k.a
"""
