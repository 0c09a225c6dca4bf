"""Exact k-nearest-neighbour join in the plane, without cross joins.

The searched points are packed into tiles of about ``TILE`` locations: strips of equal count
along x, then runs along (y, x) inside each strip. Boundaries come from an evenly hashed
sample, so a dense spot, a heavily repeated coordinate or a key holding most points only
yields more tiles. A query first looks into its own tile, which bounds the distance of its
k-th neighbour, and then only into tiles whose bounding box that distance reaches. Copies of
one location beyond k can never matter and are dropped before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import even_sample, pick_edges, position
from tidemark.session import cut

TILE = 128
SAMPLES = 32


def _distance(dx: Column, dy: Column, metric: str) -> Column:
    return F.abs(dx) + F.abs(dy) if metric == "manhattan" else F.sqrt(dx * dx + dy * dy)


def _edges(locations: DataFrame, by: list[str], sort_key: Column, parts: Column) -> DataFrame:
    """Sorted boundaries cutting each group into ``parts`` runs; one row per group.

    Boundaries are above the group's smallest key, so that no run is empty.
    """
    sizes = locations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(sort_key).alias("_least")
    )
    sizes = sizes.withColumn("_parts", parts)
    sampled = (
        locations.join(sizes.filter("_parts > 1"), by)
        .filter(even_sample([F.col("x"), F.col("y")], F.col("_parts") * SAMPLES, F.col("_n")))
        .groupBy(*by)
        .agg(
            F.sort_array(F.collect_list(sort_key)).alias("_s"),
            F.first("_parts").alias("_parts"),
            F.first("_least").alias("_least"),
        )
    )
    picked = pick_edges(F.col("_s"), F.col("_parts"))
    above = F.filter(picked, lambda e: e > F.col("_least"))
    return sampled.select(*by, above.alias("_edges"))


def _place(df: DataFrame, edges: DataFrame, by: list[str], sort_key: Column, name: str) -> DataFrame:
    at = F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(position(F.col("_edges"), sort_key))
    return df.join(edges, by, "left").withColumn(name, at).drop("_edges")


class TileIndex:
    """Tiles over ``points`` (keys, id, x, y, extra columns), ready for lookups of up to k.

    The same for every size: a key of few locations is one tile of one strip.
    """

    def __init__(self, points: DataFrame, keys: list[str], k: int, extra: list[str] = ()):
        self.keys, self.k = list(keys), k
        copies = Window.partitionBy(*keys, "x", "y").orderBy("id")
        kept = (
            points.select(*keys, "id", "x", "y", *extra)
            .withColumn("_copy", F.row_number().over(copies))
            .filter(F.col("_copy") <= k)
        )
        kept = cut(kept)
        locations = kept.filter("_copy = 1").select(*keys, "x", "y")
        strip = [*keys, "strip"]
        tile = [*strip, "tile"]
        self.run_key = F.struct("y", "x")
        n = F.col("_n")
        self.x_edges = _edges(locations, self.keys, F.col("x"), F.ceil(F.sqrt(n / F.lit(TILE))))
        stripped = _place(locations, self.x_edges, self.keys, F.col("x"), "strip")
        self.y_edges = _edges(stripped, strip, self.run_key, F.ceil(n / F.lit(TILE)))
        tiles = (
            self.locate(kept)
            .groupBy(*tile)
            .agg(
                F.collect_list(F.struct("id", "x", "y", *extra)).alias("_pts"),
                F.min("x").alias("x0"), F.max("x").alias("x1"),
                F.min("y").alias("y0"), F.max("y").alias("y1"),
            )
        )
        self.tiles = cut(tiles)
        boxes = self.tiles.drop("_pts")
        self.strip_boxes = boxes.groupBy(*strip).agg(
            F.collect_list(F.struct("tile", "x0", "x1", "y0", "y1")).alias("_boxes"),
            F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        )
        self.strips = self.strip_boxes.groupBy(*keys).agg(
            F.collect_list(F.struct("strip", "x0", "x1")).alias("_strips")
        )

    def locate(self, df: DataFrame) -> DataFrame:
        """Attach the strip and tile that hold each (x, y)."""
        placed = _place(df, self.x_edges, self.keys, F.col("x"), "strip")
        return _place(placed, self.y_edges, [*self.keys, "strip"], self.run_key, "tile")


def nearest_arrays(
    queries: DataFrame,
    points: DataFrame,
    keys: list[str],
    k: int,
    metric: str = "euclidean",
    max_radius: Column | None = None,
    extra: list[str] = (),
) -> DataFrame:
    """(keys, id, x, y, best): the k nearest points of each query as a sorted array of
    (distance, neighbor, extra columns). See ``knn_join``."""
    keys = list(keys)
    index = TileIndex(points, keys, k, list(extra))
    q_cols = [*keys, "id", "x", "y"]
    asked = queries.select(
        *q_cols, (F.lit(float("inf")) if max_radius is None else max_radius).alias("_limit")
    )

    def nearest(pts: Column) -> Column:
        ranked = F.transform(
            pts,
            lambda p: F.struct(
                _distance(F.col("x") - p["x"], F.col("y") - p["y"], metric).alias("distance"),
                p["id"].alias("neighbor"),
                *[p[c].alias(c) for c in extra],
            ),
        )
        close = F.filter(ranked, lambda c: c["distance"] <= F.col("_limit"))
        return F.slice(F.sort_array(close), 1, k)

    tile_keys = [*keys, "strip", "tile"]
    own = (
        index.locate(asked)
        .join(index.tiles.select(*tile_keys, "_pts"), tile_keys)
        .withColumn("_best", nearest(F.col("_pts")))
        .drop("_pts")
    )

    reach = F.when(
        F.size("_best") >= k, F.least(F.col("_limit"), F.element_at("_best", -1)["distance"])
    ).otherwise(F.col("_limit"))
    own = cut(own.withColumn("_reach", reach))

    def box_distance(b: Column) -> Column:
        dx = F.greatest(b["x0"] - F.col("x"), F.col("x") - b["x1"], F.lit(0.0))
        dy = F.greatest(b["y0"] - F.col("y"), F.col("y") - b["y1"], F.lit(0.0))
        return _distance(dx, dy, metric)

    q_strip, q_tile, r = F.col("_own_strip"), F.col("_own_tile"), F.col("_reach")
    outward = (
        own.select(*q_cols, "_limit", "_reach", F.col("strip").alias("_own_strip"),
                   F.col("tile").alias("_own_tile"))
        .join(index.strips, keys)
        .withColumn(
            "strip",
            F.explode(
                F.transform(
                    F.filter(
                        "_strips",
                        lambda s: (s["x0"] - r <= F.col("x")) & (F.col("x") <= s["x1"] + r),
                    ),
                    lambda s: s["strip"],
                )
            ),
        )
        .drop("_strips")
        .join(index.strip_boxes.select(*keys, "strip", "_boxes"), [*keys, "strip"])
        .withColumn(
            "tile",
            F.explode(
                F.transform(
                    F.filter(
                        "_boxes",
                        lambda b: (box_distance(b) <= r)
                        & ~((F.col("strip") == q_strip) & (b["tile"] == q_tile)),
                    ),
                    lambda b: b["tile"],
                )
            ),
        )
        .drop("_boxes")
        .join(index.tiles.select(*tile_keys, "_pts"), tile_keys)
        .select(*q_cols, nearest(F.col("_pts")).alias("_best"))
    )
    merged = (
        own.select(*q_cols, "_best")
        .unionByName(outward)
        .groupBy(*q_cols)
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("_best"))), 1, k).alias("best"))
    )
    return merged


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    keys: list[str],
    k: int,
    metric: str = "euclidean",
    max_radius: Column | None = None,
    extra: list[str] = (),
) -> DataFrame:
    """The k nearest ``points`` of each query within its key.

    Both sides carry (keys, id, x, y). Returns (keys, id, x, y, rank, neighbor, distance,
    extra columns of the neighbour); equal distances rank by neighbour id. A query finds
    itself if it is among the points. ``max_radius`` is a column of the queries; farther
    points are left out. Queries of a key without points drop out.
    """
    q_cols = [*keys, "id", "x", "y"]
    best = nearest_arrays(queries, points, keys, k, metric, max_radius, extra)
    return best.select(*q_cols, F.posexplode("best").alias("_pos", "_n")).select(
        *q_cols,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_n.neighbor").alias("neighbor"),
        F.col("_n.distance").alias("distance"),
        *[F.col(f"_n.{c}").alias(c) for c in extra],
    )


def kth_distance(queries: DataFrame, points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distance to the k-th nearest point (the query itself counts if it is a point)."""
    best = nearest_arrays(queries, points, keys, k)
    return best.select(
        *keys, "id", F.try_element_at("best", F.lit(k))["distance"].alias("kth")
    ).filter("kth IS NOT NULL")


def mean_distance(best: Column) -> Column:
    """Mean distance to the found points (fewer than k if the key has fewer); NULL if none."""
    total = F.aggregate(best, F.lit(0.0), lambda acc, p: acc + p["distance"])
    return F.try_divide(total, F.size(best))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of the component of every node: (keys, node, root).

    Alternating large-star and small-star rounds (Kiveris et al. 2014), which need a
    logarithmic number of rounds whatever the diameter. Hubs are only aggregated with a
    map-side minimum; each round's edges are checkpointed. The driver sees two numbers per
    round.
    """
    keys = list(keys)
    pair = [*keys, "u", "v"]

    def both_ways(e: DataFrame) -> DataFrame:
        swapped = e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
        return e.select(*pair).unionByName(swapped)

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            around = both_ways(e)
        else:
            around = e.select(
                *keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
            )
        low = around.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        low = low.withColumn("_m", F.least("u", "_m"))
        joined = around.join(low, [*keys, "u"])
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(
                *keys, F.col("v").alias("u"), F.col("_m").alias("v")
            )
        else:
            out = joined.select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
                low.select(*keys, "u", F.col("_m").alias("v"))
            )
        return out.filter(F.col("u") != F.col("v")).distinct()

    def fingerprint(e: DataFrame):
        return e.agg(
            F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({', '.join(pair)}))")
        ).first()

    current = cut(edges.select(*pair).filter(F.col("u") != F.col("v")).distinct())
    seen = fingerprint(current)
    while True:
        current = cut(star(star(current, True), False))
        now = fingerprint(current)
        if now == seen:
            break
        seen = now
    roots = current.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, [*keys, "node"], "left").withColumn(
        "root", F.coalesce("root", "node")
    )


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
