"""Joins by distance on the globe, over cells that are divided where they are full.

The globe is cut into bands of latitude, and each band into as many cells as are at least `step` wide at its narrower side;
the last cell of a band is the neighbour of the first, so nothing ends at +-180 degrees. A point goes to the cell that holds
it, a circle to all cells that its bounding box touches. A cell with more than `most` points and circles' centres is divided
into four, again and again up to LEVELS times, and circles follow only the quarters that they touch: the work of a full
city cell is spread over many keys, and is less, too. Divided cells are few: each holds more than a share of 1/CELLS of all
rows, so at most CELLS of them on each level, which is what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, distance
from ..sources.tables import kept

LEVELS, MOST, CELLS = 8, 4_000, 20_000
SLACK = 1.0 + 1e-9  # of a circle's bounding box, against rounding


def _cell(lat: Column, lon: Column, step: float) -> dict[str, Column]:
    """Row and column of a point's cell, the cells of its band, and its place within the cell, in 2^LEVELS parts a side."""
    row = F.floor((lat + 90) / step).cast("long")
    across = _across(row, step)
    at = F.pmod(lon + 180, F.lit(360.0)) / 360 * across
    col = F.least(F.floor(at).cast("long"), across - 1)
    part = lambda x: F.least(F.floor(x * (1 << LEVELS)).cast("long"), F.lit((1 << LEVELS) - 1))
    return {"cy": row, "cx": col, "sy": part((lat + 90) / step - row), "sx": part(at - col)}


def _across(row: Column, step: float) -> Column:
    """Cells of a band: as many as are at least step wide where it is narrowest; one where it ends at a pole."""
    lower, upper = row * step - 90, (row + 1) * step - 90
    worst = F.greatest(F.abs(lower), F.abs(upper))
    return F.when(worst >= 90, F.lit(1)).otherwise(F.greatest(F.floor(F.cos(F.radians(worst)) * 360 / step), F.lit(1))).cast("long")


def _full(points: DataFrame, most: int) -> tuple[DataFrame | None, int]:
    """level, y, x of the cells to divide, of rows with cy, cx, sy, sx; and how often cells are divided at most."""
    sizes = points.groupBy("cy", "cx").agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cap = max(most, -(-total // CELLS))
    if largest <= cap:
        return None, 0
    hot = F.broadcast(sizes.where(F.col("n") > cap).select("cy", "cx"))  # at most CELLS
    fine = kept(points.join(hot, ["cy", "cx"]).groupBy("cy", "cx", "sy", "sx").agg(F.count("*").alias("n")), "cells")
    out = None
    for level in range(LEVELS):
        of = lambda c, s: F.col(c) * (1 << level) + F.shiftright(s, LEVELS - level)  # noqa: B023, E731
        here = fine.groupBy(of("cy", "sy").alias("y"), of("cx", "sx").alias("x")).agg(F.sum("n").alias("n")).where(F.col("n") > cap)
        here = here.select(F.lit(level).alias("level"), "y", "x")
        out = here if out is None else out.unionByName(here)
    out = kept(out, "full")
    return out, out.agg(F.max("level")).first()[0] + 1


def _divided(rows: DataFrame, full: DataFrame | None, depth: int, quarters) -> DataFrame:
    """rows (level, y, x, ...) followed into the quarters of full cells. quarters(): the structs of (y, x, ...) to go to."""
    for level in range(depth):
        split = F.broadcast(full.where(F.col("level") == level).select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.lit(True).alias("_split")))
        key = (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")) & (F.col("level") == level)
        rows = rows.join(split, key, "left").drop("_y", "_x")
        names = [c for c in rows.columns if c not in ("level", "y", "x", "ux", "_split")]
        stay = F.array(F.struct(F.col("level").alias("level"), F.col("y").alias("y"), F.col("x").alias("x"), F.col("ux").alias("ux")))
        rows = rows.withColumn("_q", F.explode(F.when(F.col("_split"), quarters(level)).otherwise(stay))).select(*names, "_q.*")
    return rows


def _points(points: DataFrame, step: float, full: DataFrame | None, depth: int) -> DataFrame:
    """points (with cy, cx, sy, sx) with the level, y and x of their cell."""
    rows = points.withColumns({"level": F.lit(0), "y": F.col("cy"), "x": F.col("cx"), "ux": F.lit(0).cast("long")})

    def quarters(level: int) -> Column:
        of = lambda c, s: F.col(c) * (1 << (level + 1)) + F.shiftright(s, LEVELS - level - 1)
        return F.array(F.struct(F.lit(level + 1).alias("level"), of("cy", "sy").alias("y"), of("cx", "sx").alias("x"), F.lit(0).cast("long").alias("ux")))

    return _divided(rows, full, depth, quarters).drop("cy", "cx", "sy", "sx", "ux")


def _circles(circles: DataFrame, metres: float, step: float, full: DataFrame | None, depth: int) -> DataFrame:
    """circles (lat, lon) once for each cell that its bounding box touches."""
    reach = metres / RADIUS * SLACK  # radians
    lat, lon = F.col("c_lat"), F.pmod(F.col("c_lon") + 180, F.lit(360.0))
    pole = F.abs(lat) + F.degrees(F.lit(reach)) >= 90
    half = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(reach)) / F.cos(F.radians(lat))))) * SLACK)
    low, high = ((lat + sign * F.degrees(F.lit(reach)) + 90) / step for sign in (-1, 1))
    rows = circles.withColumns({"_low": F.greatest(low, F.lit(0.0)), "_high": F.least(high, F.lit(180.0 / step)), "_lon": lon, "_half": half})
    rows = rows.withColumn("cy", F.explode(F.sequence(F.floor("_low").cast("long"), F.floor("_high").cast("long"))))
    rows = rows.withColumn("_across", _across(F.col("cy"), step))
    side = lambda sign: (F.col("_lon") + sign * F.col("_half")) / 360 * F.col("_across")
    rows = rows.withColumns({"_left": side(-1), "_right": side(1)})
    whole = F.floor("_right") - F.floor("_left") + 1 >= F.col("_across")  # then each cell once, and all its quarters
    far = F.lit(1e18)
    rows = rows.withColumn("_whole", whole).withColumn("_from", F.floor("_left").cast("long"))
    rows = rows.withColumn("_to", F.when(F.col("_whole"), F.col("_from") + F.col("_across") - 1).otherwise(F.floor("_right")).cast("long"))
    rows = rows.withColumns({"_left": F.when(F.col("_whole"), -far).otherwise(F.col("_left")), "_right": F.when(F.col("_whole"), far).otherwise(F.col("_right"))})
    rows = rows.withColumn("ux", F.explode(F.sequence("_from", "_to"))).withColumn("x", F.pmod("ux", "_across"))
    rows = rows.withColumn("_turn", F.col("ux") - F.col("x"))  # what to take off an unwrapped column
    rows = rows.withColumns({"level": F.lit(0), "y": F.col("cy")}).drop("cy", "_from", "_to", "_whole", "_across", "_lon", "_half")

    def quarters(level: int) -> Column:
        parts = float(1 << (level + 1))
        found = []
        for dy in (0, 1):
            for dx in (0, 1):
                y, ux = F.col("y") * 2 + dy, F.col("ux") * 2 + dx
                touched = (y <= F.col("_high") * parts) & (y + 1 >= F.col("_low") * parts) & (ux <= F.col("_right") * parts) & (ux + 1 >= F.col("_left") * parts)
                to = F.struct(F.lit(level + 1).alias("level"), y.alias("y"), (ux - F.col("_turn") * (1 << (level + 1))).alias("x"), ux.alias("ux"))
                found.append(F.when(touched, to))
        return F.array_compact(F.array(*found))

    return _divided(rows, full, depth, quarters).drop("ux", "_turn", "_low", "_high", "_left", "_right")


def _celled(circles: DataFrame, points: DataFrame, metres: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells that they meet in. Rows without a place, or off the globe, are in none."""
    step = min(180.0, max(metres, 0.01) / (RADIUS * 3.141592653589793 / 180) * 1.12)
    there = lambda a, b: F.abs(F.col(a)).between(0, 90) & F.abs(F.col(b)).between(0, 1e6)
    circles, points = circles.where(there("c_lat", "c_lon")), points.where(there("p_lat", "p_lon"))
    points = points.withColumns(_cell(F.col("p_lat"), F.col("p_lon"), step))
    centres = circles.select(*[c.alias(n) for n, c in _cell(F.col("c_lat"), F.col("c_lon"), step).items()])
    full, depth = _full(points.select("cy", "cx", "sy", "sx").unionByName(centres), most)
    return _circles(circles, metres, step, full, depth), _points(points, step, full, depth)


def _near(metres: float) -> Column:
    return distance(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon")) <= metres


def pairs_within(circles: DataFrame, points: DataFrame, metres: float, most: int = MOST) -> DataFrame:
    """All columns of circles (with c_lat, c_lon) and points (with p_lat, p_lon) of each pair up to `metres` apart."""
    c, p = _celled(circles, points, metres, most)
    return c.join(p, ["level", "y", "x"]).where(_near(metres)).drop("level", "y", "x")


def with_any_within(circles: DataFrame, points: DataFrame, metres: float, most: int = MOST) -> DataFrame:
    """The circles (with c_lat, c_lon) that have any point (p_lat, p_lon) within: once for each cell where they have one."""
    c, p = _celled(circles, points.select("p_lat", "p_lon"), metres, most)
    p = p.select(*[F.col(x).alias(f"_{x}") for x in ("level", "y", "x")], "p_lat", "p_lon")
    met = (F.col("level") == F.col("_level")) & (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")) & _near(metres)
    return c.join(p, met, "left_semi").drop("level", "y", "x")

