"""Point clouds: voxels, nearest neighbours, insertion, cropping, logical deletion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.session import written

XYZ = ("x", "y", "z")
CELL = ("cx", "cy", "cz")


def with_cells(points: DataFrame, size: float) -> DataFrame:
    """points with the numbers of their grid cells."""
    return points.select("*", *(c.cell(F.col(a), size).alias(n) for a, n in zip(XYZ, CELL, strict=True)))


def voxel_centroid(points: DataFrame, leaf: float, by: Sequence[str] = (), extra: Sequence[str] = ("intensity",)) -> DataFrame:
    """One row per occupied voxel: its cell, the mean position and mean of `extra`, and the number of points.
    Points with a non-finite coordinate are left out."""
    solid = with_cells(points.filter(c.finite(c.vector(*XYZ))), leaf)
    means = [F.avg(a).alias(a) for a in (*XYZ, *extra)]
    return solid.groupBy(*by, *CELL).agg(*means, F.count("*").alias("n"))


def _around(points: DataFrame, size: float) -> DataFrame:
    """points once for each of the 27 cells around and at their own."""
    steps = F.array(*(F.struct(*(F.lit(s).cast("long").alias(n) for s, n in zip(o, CELL, strict=True))) for o in _OFFSETS))
    near = with_cells(points, size).withColumn("_o", F.explode(steps))
    moved = {n: F.col(n) + F.col(f"_o.{n}") for n in CELL}
    return near.withColumns(moved).drop("_o")


_OFFSETS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def neighbours_within(queries: DataFrame, points: DataFrame, radius: float, query_id: str, point_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Every (query, point) pair within the radius: query columns, p_<point column>, d2.

    Grid cells have the radius as their side, so an equi-join on the 27 cells around each query finds all of them;
    hot cells are split by AQE's skew join."""
    renamed = with_cells(points, radius).select(*by, *CELL, F.col(point_id), *(F.col(a).alias(f"p_{a}") for a in XYZ))
    pairs = _around(queries, radius).join(renamed, [*by, *CELL]).drop(*CELL)
    d2 = c.squared_distance(c.vector(*XYZ), c.vector(*(f"p_{a}" for a in XYZ)))
    return pairs.withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def _ranked(pairs: DataFrame, query_id: str, point_id: str, k: int) -> DataFrame:
    order = W.partitionBy(query_id).orderBy("d2", point_id)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_within(queries: DataFrame, points: DataFrame, k: int, radius: float, query_id: str, point_id: str, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest points within the radius of each query; ties by point id. Exact: no nearer point is outside."""
    return _ranked(neighbours_within(queries, points, radius, query_id, point_id, by), query_id, point_id, k)


#: Radii of the levels of an expanding search.
LEVELS = (0.25, 0.5, 1.0, 5.0**0.5)


def knn_expanding(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, radii: Sequence[float] = LEVELS, by: Sequence[str] = ()) -> DataFrame:
    """As knn_within(radii[-1]), by ever wider grids: a query is done at the first radius that holds k points, so dense
    places never meet the wide cells' many pairs. Each level's pairs and open queries are written tables, so the plan
    does not grow with the levels; the search ends when no query is open."""
    out, rest = None, queries
    for level, radius in enumerate(radii):
        last = level == len(radii) - 1
        found = written(knn_within(rest, points, k, radius, query_id, point_id, by), "knn-pairs")
        full = found.filter(F.col("rank") == k).select(query_id)
        done = found if last else found.join(full, query_id, "left_semi")
        out = done if out is None else out.unionByName(done)
        if not last:
            rest = written(rest.join(full, query_id, "left_anti"), "knn-open")
            if rest.isEmpty():
                break
    return out


def knn_unbounded(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, start: float, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest points of each query however far (all of them if fewer than k): the grid's side doubles until
    every query has k points within it or the grid is wider than the cloud."""
    span = points.agg(*(F.max(a).alias(f"h_{a}") for a in XYZ), *(F.min(a).alias(f"l_{a}") for a in XYZ))
    far = queries.agg(*(F.max(a).alias(f"h_{a}") for a in XYZ), *(F.min(a).alias(f"l_{a}") for a in XYZ))
    low, high = span.first(), far.first()
    if low["h_x"] is None or high["h_x"] is None:
        return knn_within(queries, points, k, start, query_id, point_id, by)
    widest = sum((max(low[f"h_{a}"], high[f"h_{a}"]) - min(low[f"l_{a}"], high[f"l_{a}"])) ** 2 for a in XYZ) ** 0.5
    radii = [start]
    while radii[-1] <= widest:
        radii.append(2 * radii[-1])
    return knn_expanding(queries, points, k, query_id, point_id, radii, by)


#: The side of a block of the block search, in radii.
BLOCK_SIDE = 4
#: Pairs of a query and a point that the block search compares at once.
PAIRS = 1 << 20


class _Block:
    """The k nearest points within the squared distance d2 of the queries of one block. Rows come in order: queries, then
    points, each by position and id, so that of points at one place all but the k smallest ids are passed over, and
    queries at one place are searched for once."""

    def __init__(self, key: tuple[int, ...], k: int, d2: float):
        self.key, self.k, self.d2 = key, k, d2
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids = None
        self.run, self.last = 0, None

    def add(self, is_point: np.ndarray, ids: np.ndarray, xyz: np.ndarray) -> None:
        split = int(np.searchsorted(is_point, True))
        if split:
            self.asked.append((ids[:split], xyz[:split]))
        if split < len(ids) and self.asked:  # a block without queries needs no points
            self._meet(ids[split:], xyz[split:])

    def _start(self) -> None:
        if self.ids is not None:
            return
        self.ids, self.xyz = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        bits = self.xyz.view(np.int64)
        new = np.append(True, (bits[1:] != bits[:-1]).any(1))
        self.which, self.at = np.cumsum(new) - 1, self.xyz[new]
        self.bound = np.full(len(self.at), self.d2)
        self.found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty((0, 3)))
        self.more: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def _meet(self, ids: np.ndarray, xyz: np.ndarray) -> None:
        self._start()
        bits = xyz.view(np.int64)
        same = (bits == np.vstack([bits[:1] if self.last is None else self.last, bits[:-1]])).all(1)
        same[0] &= self.last is not None
        n = np.arange(len(ids))
        start = np.maximum.accumulate(np.where(same, -1, n))
        nth = np.where(start < 0, n + self.run, n - start)
        self.run, self.last = int(nth[-1]) + 1, bits[-1:].copy()
        ids, xyz = ids[nth < self.k], xyz[nth < self.k]
        if not len(ids):
            return
        step = max(1, PAIRS // len(ids))
        for low in range(0, len(self.at), step):
            at, bound = self.at[low : low + step], self.bound[low : low + step]
            x, y, z = (at[:, i, None] - xyz[None, :, i] for i in range(3))
            d2 = x * x + y * y + z * z
            near = d2 <= bound[:, None]
            if len(ids) > self.k and np.count_nonzero(near) > 8 * self.k * len(at):
                near &= d2 <= np.partition(d2, self.k - 1, 1)[:, self.k - 1, None]  # ties stay
            q, p = np.nonzero(near)
            self.more.append((q + low, d2[q, p], ids[p], xyz[p]))
            self.held += len(q)
            if self.held > PAIRS:
                self._trim()

    def _trim(self) -> None:
        q, d2, ids, xyz = (np.concatenate(x) for x in zip(self.found, *self.more, strict=True))
        order = np.lexsort((ids, d2, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.found, self.more, self.held = (q[rank < self.k], d2[keep], ids[keep], xyz[keep]), [], 0
        full = rank == self.k - 1
        self.bound[q[full]] = d2[order[full]]

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """id, x, y, z, point_id, p_x, p_y, p_z, d2, rank. Unless this is the last search, a query with fewer than k points
        has one row of rank 0 instead of its points."""
        if not self.asked:
            return
        self._start()
        self._trim()
        q, d2, ids, xyz = self.found
        count, first = np.bincount(q, minlength=len(self.at)), np.searchsorted(q, np.arange(len(self.at)))
        open_ = np.zeros(len(self.ids), bool) if last else count[self.which] < self.k
        n = np.where(open_, 0, count[self.which])
        row = np.repeat(np.arange(len(n)), n)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        take = first[self.which[row]] + rank
        yield _rows(self.ids[row], self.xyz[row], ids[take], xyz[take], d2[take], rank + 1)
        left = np.flatnonzero(open_)
        yield _rows(self.ids[left], self.xyz[left], left, self.xyz[left], np.zeros(len(left)), np.zeros(len(left), np.int64))


def _rows(ids: np.ndarray, xyz: np.ndarray, point_ids: np.ndarray, points: np.ndarray, d2: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    columns = [ids, *xyz.T, point_ids, *points.T, d2, rank.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["id", *XYZ, "point_id", "p_x", "p_y", "p_z", "d2", "rank"])


def _search_blocks(queries: DataFrame, points: DataFrame, k: int, radius: float, d2: float, last: bool) -> DataFrame:
    """_Block.rows of all queries (id, x, y, z) among points (id, x, y, z): a block gets the points within it and the
    radius around it."""
    side = BLOCK_SIDE * radius
    home = with_cells(queries, side).withColumn("is_point", F.lit(False))
    spread = points.withColumn("is_point", F.lit(True))
    for a, n in zip(XYZ, CELL, strict=True):
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(a) * 1e-15  # more than rounding takes away
        spread = spread.withColumn(n, F.explode(F.sequence(c.cell(F.col(a) - reach, side), c.cell(F.col(a) + reach, side))))
    order = (*CELL, "is_point", *XYZ, "id")
    rows = home.unionByName(spread).select(*CELL, "is_point", "id", *XYZ).repartition(*CELL).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            if not b.num_rows:
                continue
            cells, is_point, ids = np.stack([b.column(i).to_numpy() for i in range(3)], 1), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
            xyz = np.stack([b.column(i).to_numpy() for i in range(5, 8)], 1)
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(cells[start].tolist())
                if block is None or block.key != key:
                    if block is not None:
                        yield from block.rows(last)
                    block = _Block(key, k, d2)
                block.add(is_point[start:stop], ids[start:stop], xyz[start:stop])
        if block is not None:
            yield from block.rows(last)

    return rows.mapInArrow(run, "id long, x double, y double, z double, point_id long, p_x double, p_y double, p_z double, d2 double, rank int")


def _radii(points: DataFrame, k: int, radius: float) -> list[float]:
    """Radii that double up to `radius`, from one whose cells hold about k points, in the geometric mean over all points;
    where halving hardly thins the cells out, as with copies, from there."""
    radii, before = [radius], float("inf")
    while len(radii) < 30:
        cells = with_cells(points, radii[0]).groupBy(*CELL).agg(F.count("*").alias("n"))
        held = cells.agg((F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("e")).first()["e"]
        if held is None or 2**held <= 2 * k or held > before - 0.5:
            break
        before = held
        for _ in range(max(1, int((held - np.log2(k)) / 3))):
            radii.insert(0, radii[0] / 2)
    return radii


def knn_blocks(queries: DataFrame, points: DataFrame, k: int, d2: float, query_id: str, point_id: str) -> DataFrame:
    """As knn_within(sqrt(d2)), for clouds where that radius holds far more than k points: query_id, x, y, z, point_id,
    p_x, p_y, p_z, d2, rank; integer ids.

    The radii follow the cloud's density, and a query is done at the first that holds k points. At each, space is cut into
    blocks, and one task compares a block's open queries with the points in it and around it. Pairs that are not among a
    query's k nearest never become rows: what is moved are a few copies of the points and one row of each open query."""
    solid = c.finite(c.vector(*XYZ))
    slim = [written(df.filter(solid).select(F.col(i).cast("long").alias("id"), *XYZ), n) for df, i, n in ((queries, query_id, "knn-queries"), (points, point_id, "knn-points"))]
    out, (rest, held) = None, slim
    radii = _radii(held, k, d2**0.5)
    for level, radius in enumerate(radii):
        last = level == len(radii) - 1
        found = written(_search_blocks(rest, held, k, radius, d2 if last else radius * radius, last), "knn-blocks")
        done = found.filter("rank > 0").drop("rank")
        out = done if out is None else out.unionByName(done)
        if not last:
            rest = found.filter("rank = 0").select("id", *XYZ)
            if rest.isEmpty():
                break
    return _ranked(out.withColumnsRenamed({"point_id": point_id, "id": query_id}), query_id, point_id, k)  # rows that repeat an id are one query


def insert_new(points: DataFrame, existing: DataFrame, leaf: float, by: Sequence[str] = ()) -> DataFrame:
    """The points with no existing point nearer than leaf: a spatial anti-join. Points of one batch are not compared
    with one another. The rows are numbered once, in a written table: numbers given anew on either side of the join
    could differ. Points with an id need none, see insert_new_by_id."""
    held = with_cells(existing, leaf).select(*by, *CELL, *(F.col(a).alias(f"p_{a}") for a in XYZ))
    near = c.squared_distance(c.vector(*XYZ), c.vector(*(f"p_{a}" for a in XYZ))) < leaf * leaf
    marked = written(points.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    taken = _around(marked, leaf).join(held, [*by, *CELL]).filter(near).select("_row").distinct()
    return marked.join(taken, "_row", "left_anti").drop("_row")


def insert_new_by_id(points: DataFrame, existing: DataFrame, leaf: float, point_id: str) -> DataFrame:
    """insert_new for points that have an id: no row number is needed, and the plan can be run again at will."""
    held = with_cells(existing, leaf).select(*CELL, *(F.col(a).alias(f"p_{a}") for a in XYZ))
    near = c.squared_distance(c.vector(*XYZ), c.vector(*(f"p_{a}" for a in XYZ))) < leaf * leaf
    taken = _around(points, leaf).join(held, list(CELL)).filter(near).select(point_id).distinct()
    return points.join(taken, point_id, "left_anti")


def crop_box(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """The points in the closed box."""
    return points.filter(c.in_box(c.vector(*XYZ), low, high))


def needs_slide(position: Sequence[Column], low: Sequence[Column], high: Sequence[Column], margin: float) -> Column:
    """True if a face of the box is nearer than the margin."""
    return F.least(*(x - lo for x, lo in zip(position, low, strict=True)), *(hi - x for x, hi in zip(position, high, strict=True))) < margin


def remove_box(points: DataFrame, low: Sequence[float], high: Sequence[float], stamp: int) -> DataFrame:
    """Logical deletion: live points in the closed box get valid_to = stamp."""
    gone = F.col("valid_to").isNull() & c.in_box(c.vector(*XYZ), low, high)
    return points.withColumn("valid_to", F.when(gone, F.lit(stamp)).otherwise(F.col("valid_to")))


def append_points(points: DataFrame, new: DataFrame, stamp: int) -> DataFrame:
    """points and new ones, live from stamp on."""
    fresh = new.select("*", F.lit(stamp).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return points.unionByName(fresh)


def live(points: DataFrame) -> DataFrame:
    return points.filter("valid_to is null")


def compact(points: DataFrame, before: int) -> DataFrame:
    """points without those deleted before a stamp."""
    return points.filter(F.col("valid_to").isNull() | (F.col("valid_to") >= before))


def cell_summary(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Per cell the live and deleted points and the live ones' bounds."""
    alive = F.col("valid_to").isNull()
    bounds = [f(F.when(alive, F.col(a))).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in XYZ]
    return with_cells(points, size).groupBy(*by, *CELL).agg(F.count("*").alias("n_all"), F.count_if(alive).alias("n_live"), *bounds)
