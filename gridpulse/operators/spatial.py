"""Points near other points, and regions that contain a point (problem 6).

Near points: coordinates become three-dimensional unit vectors; the space is partitioned by k-d splits; each query point is
copied to every cell within the search radius (halo), and each cell is searched by a local k-d descent with a chord
radius that provably covers the metres asked for. Cells are cut by the points of both sides, as many as there are points for,
so a dense spot of either side is split, and a cell's pairs leave it in pieces. The exact metric is applied last. Equal points are searched once, so a
point shared by a third of all rows costs one search; rows are joined back by their point.

Regions: the edges of all polygons are swept over the points in order of latitude; each edge meets only the points
between its two ends and flips their parity (even-odd rule). Polygons beyond what a task may hold are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.plans.lineage import blocks, settled

M_PER_LAT, M_PER_LON = 111_000.0, 102_000.0
#: Most vertices of polygons that are handed to every task at a time; more are taken in several blocks.
MOST_VERTICES = 2_000_000
#: Points of both sides aimed at in a k-d cell, and how many sampled points a cell's cuts rest on (and at least in all).
#: The sample sets only where cells are cut; the driver holds one point for each CELL_POINTS / PER_CELL.
CELL_POINTS, PER_CELL, LEAST_SAMPLE = 20_000, 16, 20_000
#: Pairs in a frame that leaves a cell.
PIECE = 500_000


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def chord(metres: float) -> float:
    """A chord that no two points within these planar metres exceed.

    The chord between two unit vectors is at most the length of (dlat, dlon) in radians, and a planar distance of m metres
    bounds that length by m / min(M_PER_LAT, M_PER_LON) degrees, for any latitude, also one out of range.
    """
    return float(np.radians(metres / min(M_PER_LAT, M_PER_LON))) * (1 + 1e-9) + 1e-12


def kd_splits(points: np.ndarray, cells: int) -> list:
    """Nested [axis, value, left, right] with cell numbers as leaves."""
    number = iter(range(1 << 30))

    def cut(p: np.ndarray, parts: int) -> list | int:
        spans = np.ptp(p, axis=0) if len(p) else np.zeros(3)
        axis = int(np.argmax(spans))
        if parts < 2 or len(p) < 2 or spans[axis] == 0:
            return next(number)
        value = float(np.median(p[:, axis]))
        low = p[:, axis] <= value
        if low.all():
            value = float(p[:, axis][p[:, axis] < value].max())
            low = p[:, axis] <= value
        return [axis, value, cut(p[low], parts // 2), cut(p[~low], parts - parts // 2)]

    return cut(points, cells)


def cells_of(points: np.ndarray, tree: list | int, halo: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs; with halo 0 exactly one cell for each row."""
    rows, cells = [], []

    def walk(at: list | int, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if isinstance(at, int):
            rows.append(idx)
            cells.append(np.full(len(idx), at))
            return
        x = points[idx, at[0]]
        walk(at[2], idx[x <= at[1] + halo])
        walk(at[3], idx[x > at[1] - halo])

    walk(tree, np.arange(len(points)))
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, int), np.empty(0, int))


def kd_pieces(queries: np.ndarray, points: np.ndarray, radius: float, leaf: int = 48, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the chord radius, in pieces; one descent of the k-d tree carries all queries along."""
    left, right, held = [], [], 0
    stack = [(np.arange(len(queries)), np.arange(len(points)))]
    while stack:
        q, p = stack.pop()
        if not len(q) or not len(p):
            continue
        span = np.ptp(points[p], axis=0)
        axis = int(np.argmax(span))
        if len(p) <= leaf or span[axis] == 0:
            for at in range(0, len(p), leaf):
                some = p[at : at + leaf]
                for part in (q[n : n + 4096] for n in range(0, len(q), 4096)):
                    i, j = np.nonzero(((queries[part][:, None, :] - points[some][None, :, :]) ** 2).sum(2) <= radius * radius)
                    left.append(part[i])
                    right.append(some[j])
                    held += len(i)
                    if held >= piece:
                        yield np.concatenate(left), np.concatenate(right)
                        left, right, held = [], [], 0
            continue
        x, y = points[p, axis], queries[q, axis]
        value = np.median(x)
        low = x <= value
        if low.all():
            value = x[x < value].max()
            low = x <= value
        stack.append((q[y <= value + radius], p[low]))
        stack.append((q[y >= value - radius], p[~low]))
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _usable(df: DataFrame, key: str) -> DataFrame:
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    finite = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < 1e6) & (F.abs(lon) < 1e6)
    return df.where(F.col(key).isNotNull() & lat.isNotNull() & lon.isNotNull() & finite).select(F.col(key).alias("id"), (lat + 0.0).alias("lat"), (lon + 0.0).alias("lon")).distinct()


def sampled(points: DataFrame, total: int, wanted: int) -> np.ndarray:
    """About so many of the points, chosen by their hash."""
    share = min(1.0, wanted / max(total, 1))
    rows = points.where(F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)).collect()
    return np.array([(r.lat, r.lon) for r in rows], float).reshape(-1, 2)


def near(queries: DataFrame, query_key: str, points: DataFrame, point_key: str, metres: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """(id_q, id_p) of all pairs whose points, as written, lie within the metres of the planar metric.

    Rows without a key or with a null, NaN or infinite coordinate have no pair; repeated rows count once; points out of
    the range of latitudes are compared as written; an empty table gives none; extra columns are ignored.
    """
    q, p = settled(_usable(queries, query_key)), settled(_usable(points, point_key))
    q_points, p_points = q.select("lat", "lon").distinct(), p.select("lat", "lon").distinct()
    both = settled(q_points.withColumn("asks", F.lit(True)).unionByName(p_points.withColumn("asks", F.lit(False))))
    total = both.count()
    cells = max(1, -(-total // cell_points))
    spread = sampled(both, total, max(LEAST_SAMPLE, PER_CELL * cells))
    radius = chord(metres)
    shared = both.sparkSession.sparkContext.broadcast(kd_splits(unit_vectors(spread[:, 0], spread[:, 1]), cells))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for asks, g in b.groupby("asks"):
                lat, lon = g["lat"].to_numpy(float), g["lon"].to_numpy(float)
                rows, cell = cells_of(unit_vectors(lat, lon), shared.value, radius if asks else 0.0)
                yield pd.DataFrame({"cell": cell, "lat": lat[rows], "lon": lon[rows], "asks": asks})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = pd.concat(list(batches))
        a, b = cell[cell["asks"]], cell[~cell["asks"]]
        alat, alon, blat, blon = (x.to_numpy(float) for x in (a["lat"], a["lon"], b["lat"], b["lon"]))
        for i, j in kd_pieces(unit_vectors(alat, alon), unit_vectors(blat, blon), radius):
            yield pd.DataFrame({"qlat": alat[i], "qlon": alon[i], "plat": blat[j], "plon": blon[j]})

    found = both.mapInPandas(placed, "cell long, lat double, lon double, asks boolean").groupBy("cell").applyInPandas(search, "qlat double, qlon double, plat double, plon double")
    dy, dx = (F.col("qlat") - F.col("plat")) * M_PER_LAT, (F.col("qlon") - F.col("plon")) * M_PER_LON
    close = found.where(F.sqrt(dy * dy + dx * dx) <= metres)
    ids_q, ids_p = q.select(F.col("id").alias("id_q"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), p.select(F.col("id").alias("id_p"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return close.join(ids_q, ["qlat", "qlon"]).join(ids_p, ["plat", "plon"]).select("id_q", "id_p").distinct()


def sweep(lat: np.ndarray, lon: np.ndarray, rings: list[tuple[np.ndarray, np.ndarray]], spans: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(point, ring) pairs, even-odd rule. rings: (lat, lon) of the vertices, the last joined to the first.

    spans: the least and greatest latitude of each ring; rings that no point's latitude meets are passed over at once.
    """
    order = np.argsort(lat, kind="stable")
    y, x = lat[order], lon[order]
    points, regions = [np.empty(0, int)], [np.empty(0, int)]
    spans = spans_of(rings) if spans is None else spans
    firsts, lasts = np.searchsorted(y, spans[:, 0], "left"), np.searchsorted(y, spans[:, 1], "left")
    for n in np.nonzero(firsts < lasts)[0]:
        (ry, rx), lo, hi = rings[n], firsts[n], lasts[n]
        odd = np.zeros(hi - lo, bool)
        y2, x2 = np.roll(ry, -1), np.roll(rx, -1)
        starts, ends = np.searchsorted(y, np.minimum(ry, y2), "left") - lo, np.searchsorted(y, np.maximum(ry, y2), "left") - lo
        for k in np.nonzero(starts < ends)[0]:
            s = slice(starts[k], ends[k])
            odd[s] ^= x[lo:hi][s] < (x2[k] - rx[k]) * (y[lo:hi][s] - ry[k]) / (y2[k] - ry[k]) + rx[k]
        inside = np.nonzero(odd)[0] + lo
        points.append(order[inside])
        regions.append(np.full(len(inside), n))
    return np.concatenate(points), np.concatenate(regions)


def spans_of(rings: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([(ry.min(), ry.max()) if len(ry) > 2 else (0.0, 0.0) for ry, _ in rings], float).reshape(-1, 2)


def contains(points: DataFrame, point_key: str, regions: DataFrame, region_key: str, ring: str, most: int = MOST_VERTICES) -> DataFrame:
    """(id_p, id_r) of each region whose ring (array of lon, lat) contains the point as written.

    A ring may repeat its first vertex or not; one with less than three vertices, or null ones, contains nothing. Null or
    NaN coordinates lie nowhere; repeated rows count once. Regions of more than `most` vertices are swept in blocks.
    """
    usable = _usable(points, point_key)
    listed = regions.where(F.col(region_key).isNotNull() & F.col(ring).isNotNull()).select(region_key, ring).distinct()
    out = None
    for block in blocks(listed, F.size(ring), most):
        keys, rings = [], []
        for key, vertices in block.collect():
            if all(v is not None and v["lat"] is not None and v["lon"] is not None for v in vertices):
                keys.append(key)
                rings.append((np.array([v["lat"] for v in vertices], float), np.array([v["lon"] for v in vertices], float)))
        shared = points.sparkSession.sparkContext.broadcast((np.array(keys, dtype="int64"), rings, spans_of(rings)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, rings, spans = shared.value
            for b in batches:
                i, j = sweep(b["lat"].to_numpy(float), b["lon"].to_numpy(float), rings, spans)
                yield pd.DataFrame({"id_p": b["id"].to_numpy()[i], "id_r": names[j]})

        found = usable.mapInPandas(run, "id_p long, id_r long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
