"""Greedy radius clustering of map points, exact and in parallel, for many radii at once.

Taken in order, a point founds a cluster unless an earlier founder lies within the
radius; otherwise it joins the earliest such founder. The founders are the
lexicographically first maximal independent set of the radius graph (Blelloch,
Fineman, Shun, SPAA 2012).

The graph itself is never built. Cells are so small that all points of a cell lie
within the radius of each other, so a cell has at most one founder. All radii share
the rounds: a row is a coordinate at one radius, and cells are keyed by the radius too.

The first round takes local minima: the earliest undecided point of each cell against
those of the cells around it. What remains are chains of points that wait for each
other. The other rounds deal cells to square blocks; a task walks through its block in
order and decides every point all of whose earlier neighbours it knows, however long the
chain. Points that wait for something outside stay. Blocks grow fourfold in width per round
while none holds too many cells, so a chain that crosses many blocks ends after as many
rounds as its length has digits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.numbers import cluster_radius
from stratalog.session import durable

# A little less than 1/sqrt(2), so that a cell's diagonal is shorter than the radius.
_CELL_PER_RADIUS = 0.7071
# Cells are split into salted pieces of about so many coordinates for the joins.
_ROWS_PER_SALT = 250_000
# Cells to a block's side in the first walk, and how many occupied cells a block may hold for blocks to grow.
_FIRST_SIDE, _GROWTH, _CELLS_PER_BLOCK = 32, 4, 20_000
# A walk takes this many of a cell's earliest points; later ones count as unknown.
_HEADS = 16


def placeable(lat: str = "lat", lon: str = "lon") -> Column:
    """Whether a point has finite coordinates. One without is near nothing, not even itself: it stays single."""
    finite = [F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.col(c).cast("double")) for c in (lat, lon)]
    return finite[0] & finite[1]


def _cell(c: str) -> Column:
    return F.floor(F.col(c) / (F.col("radius") * F.lit(_CELL_PER_RADIUS))).cast("bigint")


# Copies of a row for every cell within the radius, and there for each of its pieces.
_REACH = """
    select ord, lat, lon, radius, x, y, salt
    from (select w.*, coalesce(h.salts, 1) as pieces
          from (select ord, lat, lon, radius, x, y
                from {rows} lateral view explode(sequence(cx - 2, cx + 2)) as x lateral view explode(sequence(cy - 2, cy + 2)) as y) w
          left join {hot} h on h.radius = w.radius and h.cx = w.x and h.cy = w.y)
    lateral view explode(sequence(0, pieces - 1)) as salt
"""
_NEAR = """
    p.radius = r.radius and p.cx = r.x and p.cy = r.y and p.salt = r.salt
    and sqrt((r.lat - p.lat) * (r.lat - p.lat) + (r.lon - p.lon) * (r.lon - p.lon)) <= p.radius
"""


def _reach(rows: str) -> str:
    return _REACH.replace("{rows}", rows)


# New founders: a cell's earliest undecided point, unless an earlier undecided one of a neighbouring cell lies within the radius.
_MINIMA = f"""
    with candidate as (
        select radius, cx, cy, first.ord, first.lat, first.lon
        from (select radius, cx, cy, min(struct(ord, lat, lon)) as first from {{undecided}} group by radius, cx, cy)
    ),
    blocked as (
        select distinct r.radius, r.ord
        from {{undecided}} p join ({_reach("candidate")}) r on {_NEAR} and p.ord < r.ord
    )
    select c.radius, c.ord, c.lat, c.lon, c.cx, c.cy from candidate c left anti join blocked b on c.radius = b.radius and c.ord = b.ord
"""
# The points that none of the new founders covers.
_UNCOVERED = f"select * from {{undecided}} p left anti join ({_reach('{chosen}')}) r on {_NEAR}"


def _cells(points: DataFrame, radii: Sequence[float], order: str) -> tuple[DataFrame, DataFrame]:
    """Distinct finite coordinates at every radius, with first order, size, cell and salt; and the pieces of cells that have several."""
    sites = points.filter(placeable()).groupBy("lat", "lon").agg(F.min(order).alias("ord"), F.count(F.lit(1)).alias("n"))
    at_radii = sites.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    cells = durable(at_radii.withColumns({"cx": _cell("lat"), "cy": _cell("lon")}))
    crowded = cells.groupBy("radius", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / _ROWS_PER_SALT).cast("int").alias("salts"))
    hot = durable(crowded.filter("salts > 1"))
    salt = F.pmod(F.xxhash64("ord"), F.coalesce("salts", F.lit(1))).cast("int")
    return durable(cells.join(hot, ["radius", "cx", "cy"], "left").withColumn("salt", salt).drop("salts")), hot


def _walk(rows: Iterable[tuple]) -> list[tuple]:
    """The founders among a block's own points, which come by ascending order as (ord, lat, lon, cx, cy, own, tail, radius).

    Points that are not ``own`` lie around the block and stay unknown unless a founder covers them. A ``tail`` stands for all later points of its
    cell, whose places are not known.
    """
    founders, unknown, tails = {}, defaultdict(list), set()
    out = []
    for ord_, lat, lon, cx, cy, own, tail, radius in rows:
        if tail:
            tails.add((cx, cy))
            continue

        def near(a: float, b: float) -> bool:
            return math.sqrt((a - lat) * (a - lat) + (b - lon) * (b - lon)) <= radius

        around = [(x, y) for x in range(cx - 2, cx + 3) for y in range(cy - 2, cy + 3)]
        if any(near(*founders[c]) for c in around if c in founders):
            continue
        if own and not any(c in tails or any(near(a, b) for a, b in unknown.get(c, ())) for c in around):
            founders[cx, cy] = (lat, lon)
            out.append((ord_, lat, lon, cx, cy))
        else:
            unknown[cx, cy].append((lat, lon))
    return out


def _block(c: Column, side: int) -> Column:
    return F.floor(c / F.lit(side)).cast("bigint")


def _walked(undecided: DataFrame, side: int) -> DataFrame:
    """New founders by walks through blocks of ``side`` cells."""
    place = F.row_number().over(Window.partitionBy("radius", "cx", "cy").orderBy("ord"))
    heads = undecided.select("radius", "ord", "lat", "lon", "cx", "cy").withColumn("place", place).where(F.col("place") <= _HEADS + 1)

    def blocks(c: str) -> Column:
        return F.array_distinct(F.array(*[_block(F.col(c) + d, side) for d in (-2, 0, 2)]))

    dealt = heads.withColumn("bx", F.explode(blocks("cx"))).withColumn("by", F.explode(blocks("cy"))).withColumns({
        "own": (F.col("bx") == _block(F.col("cx"), side)) & (F.col("by") == _block(F.col("cy"), side)),
        "tail": F.col("place") > _HEADS,
    })

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        found = _walk(zip(*[rows[c].tolist() for c in ("ord", "lat", "lon", "cx", "cy", "own", "tail", "radius")]))
        made = pd.DataFrame(found, columns=["ord", "lat", "lon", "cx", "cy"])
        made.insert(0, "radius", rows["radius"].iloc[0])
        return made.astype({"ord": rows["ord"].dtype, "lat": "float64", "lon": "float64", "cx": "int64", "cy": "int64"})

    kind = dict(undecided.dtypes)
    return dealt.groupBy("radius", "bx", "by").applyInPandas(
        walk, f"radius double, ord {kind['ord']}, lat {kind['lat']}, lon {kind['lon']}, cx bigint, cy bigint")


def _wider(undecided: DataFrame, side: int) -> int:
    """The next width of blocks: greater if no block would hold too many cells."""
    wide = side * _GROWTH
    held = undecided.select("radius", "cx", "cy").distinct().groupBy("radius", _block(F.col("cx"), wide), _block(F.col("cy"), wide)).count()
    most = held.agg(F.max("count")).first()[0] or 0
    return wide if most <= _CELLS_PER_BLOCK else side


def _founders(cells: DataFrame, hot: DataFrame) -> DataFrame:
    spark = cells.sparkSession
    found, undecided, side = [], cells.drop("n"), _FIRST_SIDE
    while True:
        new = durable(spark.sql(_MINIMA, undecided=undecided, hot=hot) if not found else _walked(undecided, side))
        undecided = durable(spark.sql(_UNCOVERED, undecided=undecided, chosen=new, hot=hot))
        found.append(new)
        if undecided.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)
        if new.isEmpty():
            raise RuntimeError("a round found no founder")
        side = _wider(undecided, side) if len(found) > 1 else side


def assigned_sites_of(points: DataFrame, radii: Sequence[float], order: str = "ord") -> DataFrame:
    """(radius, lat, lon, ord, n, founder) per radius and distinct coordinate: the earliest founder within the radius."""
    cells, hot = _cells(points, radii, order)
    founders = _founders(cells, hot)
    query = f"""
    select p.radius, p.lat, p.lon, p.ord, p.n, min(r.ord) as founder
    from {{cells}} p join ({_reach("{founders}")}) r on {_NEAR}
    group by p.radius, p.lat, p.lon, p.ord, p.n
    """
    return points.sparkSession.sql(query, cells=cells, founders=founders, hot=hot)


def assigned_sites(points: DataFrame, radius: float, order: str = "ord") -> DataFrame:
    """(lat, lon, ord, n, founder) per distinct coordinate: the earliest founder within the radius."""
    return assigned_sites_of(points, [radius], order).drop("radius")


def cluster_members(points: DataFrame, radius: float, order: str = "ord") -> DataFrame:
    """The points with the order of their cluster's founder (a long member table). Points without finite coordinates found themselves."""
    if radius <= 0:
        return points.withColumn("founder", F.col(order))
    sites = assigned_sites(points, radius, order).select("lat", "lon", "founder")
    # Only finite coordinates are in ``sites``; the others keep their own order.
    return points.join(sites, ["lat", "lon"], "left").select(*points.columns, F.coalesce("founder", F.col(order)).alias("founder"))


def _singles(points: DataFrame, order: str) -> DataFrame:
    return points.select(F.col(order).alias("founder"), "lat", "lon", F.lit(1).cast("bigint").alias("count"))


def clusters_of(points: DataFrame, radii: Sequence[float], order: str = "ord") -> DataFrame:
    """(radius, founder, lat, lon, count) for each radius: centroid and size. A radius of 0 or less leaves every point single."""
    parts = [_singles(points, order).withColumn("radius", F.lit(float(r))) for r in radii if r <= 0]
    positive = [float(r) for r in dict.fromkeys(radii) if r > 0]
    if positive:
        n = F.col("n")
        # Coordinates carry their multiplicity, so the members need not be expanded.
        parts.append(assigned_sites_of(points, positive, order).groupBy("radius", "founder").agg(
            (F.sum(F.col("lat") * n) / F.sum(n)).alias("lat"),
            (F.sum(F.col("lon") * n) / F.sum(n)).alias("lon"),
            F.sum(n).alias("count"),
        ))
        lost = _singles(points.filter(~placeable()), order)
        parts.append(lost.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in positive]))))
    return reduce(lambda a, b: a.unionByName(b), parts).select("radius", "founder", "lat", "lon", "count")


def clusters(points: DataFrame, radius: float, order: str = "ord") -> DataFrame:
    """(founder, lat, lon, count): centroid and size; a count of 1 is a single point, as is every one without finite coordinates."""
    return clusters_of(points, [radius], order).drop("radius")


def clusters_by_altitude(points: DataFrame, altitudes: Sequence[float], order: str = "ord") -> DataFrame:
    """Clusters for each viewing altitude, tagged. All radii go through the same rounds, equal ones as one."""
    rows = points.sparkSession.createDataFrame([(float(a),) for a in altitudes], "altitude double")
    tags = defaultdict(list)
    for r in rows.select("altitude", cluster_radius(F.col("altitude")).alias("radius")).collect():
        tags[r["radius"]].append(r["altitude"])
    found = clusters_of(points, list(tags), order)
    of_radius = F.create_map(*[x for r, own in tags.items() for x in (F.lit(r), F.array(*[F.lit(a) for a in own]))])
    return found.select("founder", "lat", "lon", "count", "radius", F.explode(of_radius[F.col("radius")]).alias("altitude"))
