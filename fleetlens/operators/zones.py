"""Zones, radius pairs and nearest neighbours of stations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import EARTH_RADIUS_M, h3_cell, haversine_m, hex_cell, utm_metres
from ..session import checkpoint_dir, cut, ship, shuffle_partitions, stored

#: About as many stations as a task of linkage_zones takes with all their neighbours.
TILE_STATIONS = 10_000


def hex_zones(stations: DataFrame, edge_m: float = 460.0) -> DataFrame:
    """station_id, zone_hex: hexagons of about the size of an H3 cell of resolution 8."""
    east, north = utm_metres(F.col("lat"), F.col("lng"))
    return stations.select("station_id", hex_cell(east, north, edge_m).alias("zone_hex"))


def h3_zones(stations: DataFrame, resolution: int = 8) -> DataFrame:
    """station_id, zone_h3: the H3 cell of each station; see h3_cell for where there are ids."""
    return stations.select("station_id", h3_cell(F.col("lat"), F.col("lng"), resolution).alias("zone_h3"))


def complete_linkage(x: np.ndarray, y: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of complete linkage cut at a distance, by the nearest-neighbour chain over the whole matrix.

    Ties are broken by the lower index, so equal inputs give equal clusters.
    linkage_zones gives the same clusters without the matrix.
    """
    n = len(x)
    d = np.hypot(x[:, None] - x[None], y[:, None] - y[None])
    np.fill_diagonal(d, np.inf)
    alive, parent = np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    left = n
    while left > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(row.argmin())
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        chain = chain[:-2]
        height, (low, high) = d[i, j], sorted((i, j))
        merged = np.maximum(d[low], d[high])
        d[low], d[:, low] = merged, merged
        d[low, low] = np.inf
        alive[high] = False
        left -= 1
        if height <= cut:
            parent[high] = low
        # clusters further apart stay apart, but the chain goes on over their union
    root = np.arange(n)
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        root[i] = r
    return root


def radius_components(stations: DataFrame, radius_m: float) -> DataFrame:
    """station_id, component (its least station_id): stations that chains of hops of radius_m connect.

    Each round a station takes the least label around it, then the label of that
    label, so labels travel twice as far each time; rounds are checkpointed and
    end when no label changes.
    """
    edges = cut(radius_pairs(stations, radius_m).select("station_id", "neighbor_id"))
    labels = cut(stations.select("station_id", F.col("station_id").alias("component")).distinct())
    while True:
        near = edges.join(labels.select(F.col("station_id").alias("neighbor_id"), F.col("component").alias("c")), "neighbor_id").groupBy("station_id").agg(F.min("c").alias("c"))
        least = labels.join(near, "station_id", "left").select("station_id", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        jumped = least.join(labels.select(F.col("station_id").alias("c"), F.col("component").alias("far")), "c", "left")
        now = cut(jumped.select("station_id", F.least("c", "far").alias("component"), "old"))
        labels = now.select("station_id", "component")
        if now.filter("component != old").isEmpty():
            return labels


def merged_pairs(ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], own: np.ndarray) -> list[tuple[int, int]]:
    """(high, low) merges that the clusters marked own make among themselves, in order; pairs: places a, b, distance and number of station pairs.

    Nearest neighbours in the order of (distance, lower id) that are each
    other's merge, whatever the rest does: merging elsewhere only takes other
    clusters further away. A chain that leaves the own clusters stops there.
    """
    a, b, far, n_pairs = pairs
    near: list[dict[int, tuple[float, int]]] = [{} for _ in ids]
    for i, j, d, n in zip(a.tolist(), b.tolist(), far.tolist(), n_pairs.tolist(), strict=True):
        near[i][j] = near[j][i] = (d, n)
    merges, alive, stuck = [], [True] * len(ids), set()

    def nearest(i: int) -> int:
        return min(near[i], key=lambda j: (near[i][j][0], ids[j])) if near[i] else -1

    for begin in np.flatnonzero(own).tolist():
        chain = [begin] if alive[begin] else []
        while chain:
            i = chain[-1]
            j = nearest(i)
            if j < 0 or not own[j] or j in stuck:  # its nearest one waits for another task, so it has to wait too
                stuck.update(chain)
                break
            if len(chain) < 2 or j != chain[-2]:
                chain.append(j)
                continue
            low, high = sorted((i, j), key=lambda k: ids[k])
            merges.append((high, low))
            alive[high] = False
            both = {k: (max(near[low][k][0], near[high][k][0]), near[low][k][1] + near[high][k][1]) for k in near[low].keys() & near[high].keys()}
            for k in (near[low].keys() | near[high].keys()) - {low, high}:
                near[k].pop(low, None)
                near[k].pop(high, None)
            for k, x in both.items():
                near[k][low] = x
            freed = (near[low].keys() | near[high].keys()) - both.keys()
            near[low], near[high] = both, {}
            stuck -= freed | both.keys() | {low}  # what was nearest to them may be so no longer
            chain = chain[:-2]
    return merges


def linkage_zones(stations: DataFrame, cut_m: float = 700.0, tile_stations: int = TILE_STATIONS) -> DataFrame:
    """station_id, zone_link: complete linkage on metres cut at cut_m, named after the least station of each cluster.

    Two clusters merge while every pair of their stations is within cut_m, so
    only such pairs count: memory follows the local density, not the square of
    the stations. In rounds, squares of a grid are dealt to tasks, each merges
    what are mutual nearest neighbours within its square (merged_pairs), and the
    pairs of clusters are summed up again: of n1 and n2 stations all n1 * n2
    pairs must be there. The grid is shifted by half a square from round to
    round, so the nearest pair of all lies within a square in one of four, and
    four rounds without a merge end it. The squares are as large as they can be
    with tile_stations each, and 8 cut_m at least.
    """
    ship(stations.sparkSession)
    # files, as a checkpoint hands on all constraints of its plan, which double from round to round
    kept = lambda df: stored(df, f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}")
    east, north = utm_metres(F.col("lat"), F.col("lng"))
    kind = stations.schema["station_id"].dataType.simpleString()
    placed = kept(stations.filter("lat is not null and lng is not null").select("station_id", "lat", "lng", east.alias("x"), north.alias("y")))
    side = lambda key, i: placed.select(F.col("station_id").alias(key), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, y1, x2, y2 = (batch.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.hypot(x1 - x2, y1 - y2)), pa.array(np.ones(len(x1), np.int64))], ["a", "b", "far", "pairs"])

    close = radius_pairs(placed.repartition(shuffle_partitions(stations.sparkSession), "station_id"), cut_m * 1.02).filter("station_id < neighbor_id").select(F.col("station_id").alias("a"), F.col("neighbor_id").alias("b"))
    close = close.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "x1", "y1", "x2", "y2")
    pairs = kept(close.mapInArrow(measured, f"a {kind}, b {kind}, far double, pairs bigint").filter(F.col("far") <= cut_m))
    clusters = kept(placed.select("station_id", "x", "y", F.lit(1).cast("bigint").alias("n")))
    labels = placed.select("station_id", F.col("station_id").alias("cluster"))
    square = tile_edge(placed, 8 * cut_m, tile_stations)
    idle = shift = 0
    while idle < 4 and not pairs.isEmpty():
        tile = F.struct(*[F.floor((F.col(c) + square / 2 * (shift >> i & 1)) / square).alias(c) for i, c in enumerate("xy")])
        at = clusters.select("station_id", tile.alias("tile"))
        ends = pairs.join(at.select(F.col("station_id").alias("a"), F.col("tile").alias("ta")), "a").join(at.select(F.col("station_id").alias("b"), F.col("tile").alias("tb")), "b")
        ends = ends.select("*", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile")).select("tile", "a", "b", "far", "pairs", (F.col("ta") == F.col("tile")).alias("oa"), (F.col("tb") == F.col("tile")).alias("ob"))

        def run(table: pa.Table) -> pa.Table:
            a, b = table.column("a").to_pandas().to_numpy(), table.column("b").to_pandas().to_numpy()
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            own = np.zeros(len(ids), bool)
            own[at] = np.concatenate([table.column(c).to_numpy() for c in ("oa", "ob")])
            found = merged_pairs(ids, (at[: len(a)], at[len(a) :], table.column("far").to_numpy(), table.column("pairs").to_numpy()), own)
            root = dict(found)
            for high, low in reversed(found):
                root[high] = root.get(low, low)
            return pa.table({"old": pa.array(ids[list(root)], table.schema.field("a").type), "new": pa.array(ids[list(root.values())], table.schema.field("a").type)})

        moved = kept(ends.groupBy("tile").applyInArrow(run, f"old {kind}, new {kind}"))
        shift = (shift + 1) % 4
        if moved.isEmpty():
            idle += 1
            continue
        idle = 0
        renamed = lambda df, c: df.join(moved.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        labels = kept(renamed(labels, "cluster"))
        clusters = kept(renamed(clusters, "station_id").groupBy("station_id").agg(F.min_by("x", F.struct("y", "x")).alias("x"), F.min("y").alias("y"), F.sum("n").alias("n")))
        size = lambda c: clusters.select(F.col("station_id").alias(c), F.col("n").alias(f"n_{c}"))
        again = renamed(renamed(pairs, "a"), "b").filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("far").alias("far"), F.sum("pairs").alias("pairs"))
        pairs = kept(again.join(size("a"), "a").join(size("b"), "b").filter(F.col("pairs") == F.col("n_a") * F.col("n_b")).drop("n_a", "n_b"))
    return labels.select("station_id", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("zone_link"))


def tile_edge(placed: DataFrame, least: float, most: int) -> float:
    """The largest of least, 2 least, 4 least ... whose squares hold at most so many stations each (one square: any)."""
    edges = [least * 2**k for k in range(14)]
    level = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("edge"), F.floor(F.col("x") / e).alias("cx"), F.floor(F.col("y") / e).alias("cy")) for e in edges])).alias("c")
    counts = placed.select(level).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.edge").agg(F.max("n").alias("n"))
    return max([least, *(r.edge for r in counts.collect() if r.n <= most)])


def linkage_faults(stations: DataFrame, links: DataFrame, cut_m: float = 700.0) -> DataFrame:
    """One row: stations, over_cut (clusters with a pair further apart than cut_m), mergeable (pairs of clusters that would still fit together)."""
    east, north = utm_metres(F.col("lat"), F.col("lng"))
    at = links.join(stations.select("station_id", east.alias("x"), north.alias("y")), "station_id")
    sizes = links.groupBy("zone_link").agg(F.count("*").alias("n"))
    near = radius_pairs(stations, cut_m * 1.02)
    side = lambda i, key: at.select(F.col("station_id").alias(key), F.col("zone_link").alias(f"z{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    close = near.join(side(1, "station_id"), "station_id").join(side(2, "neighbor_id"), "neighbor_id").filter(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) <= cut_m)
    counts = close.filter("z1 <= z2").groupBy("z1", "z2").agg(F.count("*").alias("pairs"))
    size = lambda i: sizes.select(F.col("zone_link").alias(f"z{i}"), F.col("n").alias(f"n{i}"))
    inside = sizes.join(counts.filter("z1 = z2").select(F.col("z1").alias("zone_link"), "pairs"), "zone_link", "left")
    over = inside.agg(F.count_if(F.coalesce("pairs", F.lit(0)) != F.col("n") * (F.col("n") - 1)).alias("over_cut"), F.sum("n").alias("stations"))
    fits = counts.filter("z1 < z2").join(size(1), "z1").join(size(2), "z2").agg(F.count_if(F.col("pairs") == F.col("n1") * F.col("n2")).alias("mergeable"))
    return over.crossJoin(F.broadcast(fits)).select("stations", "over_cut", "mergeable")


def zone_sizes(stations: DataFrame, zone: str = "zone_agg") -> DataFrame:
    return stations.groupBy(zone).agg(F.count("*").alias("stations"))


def zone_diameters(stations: DataFrame, zone: str = "zone_agg") -> DataFrame:
    """zone, stations, diameter_m: the largest distance within a zone, 0 for one station."""
    a, b = stations.alias("a"), stations.alias("b")
    pairs = a.join(b, (F.col(f"a.{zone}") == F.col(f"b.{zone}")) & (F.col("a.station_id") <= F.col("b.station_id")))
    distance = haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return pairs.groupBy(F.col(f"a.{zone}").alias(zone)).agg(F.count_if(F.col("a.station_id") == F.col("b.station_id")).alias("stations"), F.max(distance).alias("diameter_m"))


def radius_pairs(stations: DataFrame, radius_m: float = 400.0) -> DataFrame:
    """station_id, neighbor_id, distance_m for ordered pairs within radius_m.

    Points of the sphere are dealt to cubes of that edge, and a chord is no
    longer than its arc, so stations meet in their own cube and the 26 around
    it: an equi-join whose size follows the local density, at every latitude and
    across the date line.
    """
    lat, lng, r = F.radians("lat"), F.radians("lng"), EARTH_RADIUS_M / radius_m
    at = {"cx": F.cos(lat) * F.cos(lng) * r, "cy": F.cos(lat) * F.sin(lng) * r, "cz": F.sin(lat) * r}
    own = stations.select("station_id", "lat", "lng", *[F.floor(x).alias(c) for c, x in at.items()])
    step = (-1, 0, 1)
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(ds, ("dx", "dy", "dz"), strict=True)]) for ds in product(step, step, step)]))
    near = own.select(F.col("station_id").alias("neighbor_id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), *at, around.alias("s"))
    near = near.select("neighbor_id", "lat2", "lng2", *[(F.col(c) + F.col(f"s.d{c[1]}")).alias(c) for c in at])
    near = near.hint("merge")  # 27 rows a station, which the planner takes for one and would broadcast
    pairs = own.join(near, list(at)).filter("station_id != neighbor_id").withColumn("distance_m", haversine_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")))
    return pairs.filter(F.col("distance_m") <= radius_m).select("station_id", "neighbor_id", "distance_m")


def reroute_neighbors(stations: DataFrame, max_m: float = 1000.0, max_hops: int = 3) -> DataFrame:
    """station_id, hop (1..max_hops), neighbor_id, distance_m: where a full station sends its riders."""
    w = W.partitionBy("station_id").orderBy("distance_m", "neighbor_id")
    return radius_pairs(stations, max_m).withColumn("hop", F.row_number().over(w)).filter(F.col("hop") <= max_hops).select("station_id", "hop", "neighbor_id", "distance_m")


def zone_summary(sizes: DataFrame) -> DataFrame:
    """One row: zones, single-station zones and quartiles of their sizes."""
    q = F.percentile("stations", [0.25, 0.5, 0.75])
    return sizes.agg(F.count("*").alias("zones"), F.count_if(F.col("stations") == 1).alias("singletons"), F.min("stations").alias("smallest"), F.max("stations").alias("largest"), q.alias("q")).select(
        "zones", "singletons", "smallest", "largest", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    )
