"""Spatial joins as equi-joins on grid cells.

Cells come in levels of doubling size. A box is dealt to the level whose cells are no smaller
than it, so that it meets four cells at most, however large it is; the other side is looked up
at the levels that occur. The cell equality shuffles or broadcasts like any key, skewed cells
are split by adaptive execution, and exact tests run on the pairs that share a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import measure as M
from geoframe.functions.geometry import coordinates, lat, lon, multi_point, only_position
from geoframe.functions.predicates import contains

CELL = 0.25  # degrees of the smallest cells
LEVELS = 12  # the largest cells have CELL * 2^LEVELS degrees, more than the globe


def _size(level: Column) -> Column:
    return F.lit(CELL) * F.pow(F.lit(2.0), level)


def box_level(b: Column) -> Column:
    side = F.greatest(M.east(b) - M.west(b), M.north(b) - M.south(b))
    return F.when(side <= CELL, 0).otherwise(F.least(F.ceil(F.log2(side / CELL)), F.lit(LEVELS))).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / _size(level))


def _box_cells(b: Column, level: Column) -> Column:
    """Structs (level, cx, cy) of the cells of a box."""
    span = lambda a, z: F.sequence(_cell(a, level), F.greatest(_cell(a, level), _cell(z, level)))
    return F.flatten(F.transform(span(M.west(b), M.east(b)), lambda cx: F.transform(span(M.south(b), M.north(b)), lambda cy: F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy")))))


def _levels(df: DataFrame, level: Column) -> Column:
    """The levels that occur, as a scalar subquery: no job runs before the query does."""
    return df.agg(F.array_sort(F.collect_set(level))).scalar()


def _ref(alias: str, name: str) -> Column:
    return F.col(f"{alias}.{name}")


def _is_box(g: Column, b: Column) -> Column:
    """Whether a polygon is one ring around its box, counter-clockwise from the south-west."""
    corners = ((M.west, M.south), (M.east, M.south), (M.east, M.north), (M.west, M.north), (M.west, M.south))
    return F.coalesce(g["parts"] == F.array(F.array(F.array(*[F.array(x(b), y(b)) for x, y in corners]))), F.lit(False))


def _held(points: DataFrame, polygons: DataFrame, point: str, polygon: str, ignore_boundary: bool, how: str) -> DataFrame:
    """The join of ``point`` and ``polygon`` structs; ``how`` is inner or left_semi, which may give a point more than once.

    What each pair of a cell needs stands in flat columns. Polygons that are their box are joined
    by themselves, as the walk along rings keeps a whole join from being compiled.
    """
    boxed = polygons.select(F.struct("*").alias("polygon"), M.bbox_or_computed(F.col(polygon)).alias("box")).filter("box IS NOT NULL")
    b = F.col("box")
    right = boxed.select("polygon", M.west(b).alias("w"), M.south(b).alias("s"), M.east(b).alias("e"), M.north(b).alias("n"), _is_box(F.col(f"polygon.{polygon}"), b).alias("plain"), F.explode(_box_cells(b, box_level(b))).alias("cell"))
    right = right.select("polygon", "w", "s", "e", "n", "plain", "cell.*").alias("r")
    left = points.select(F.struct("*").alias("point"), only_position(F.col(point)).alias("p")).filter("p IS NOT NULL")
    left = left.select("point", "p", lon(F.col("p")).alias("x"), lat(F.col("p")).alias("y"), F.explode(_levels(boxed, box_level(b))).alias("level")).repartition("x", "y")  # a small file may hold points of many pairs
    left = left.withColumns({"cx": _cell(F.col("x"), F.col("level")), "cy": _cell(F.col("y"), F.col("level"))}).alias("l")
    w, s, e, n, x, y = F.col("r.w"), F.col("r.s"), F.col("r.e"), F.col("r.n"), F.col("l.x"), F.col("l.y")
    same = (F.col("l.level") == F.col("r.level")) & (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy"))
    inside = (w <= x) & (s <= y) & (e >= x) & (n >= y)
    in_box = inside & (w < x) & (s < y) & (e > x) & (n > y) if ignore_boundary else inside
    in_ring = inside & contains(F.col(f"r.polygon.{polygon}"), F.col("l.p"), ignore_boundary)
    made = ["l.point"] if how == "left_semi" else ["l.point", "r.polygon"]
    return left.join(right.filter("plain"), same & in_box, how).select(*made).union(left.join(right.filter("NOT plain"), same & in_ring, how).select(*made))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point: str = "geometry", polygon: str = "geometry", ignore_boundary: bool = False) -> DataFrame:
    """All pairs of a Point row and a polygon row that holds it, as structs ``point`` and ``polygon``.

    Rows with a null geometry meet nothing. Every pair comes once, as it shares one cell.
    """
    return _held(points, polygons, point, polygon, ignore_boundary, "inner")


def filter_inside(points: DataFrame, polygons: DataFrame, key: str, point: str = "geometry", polygon: str = "geometry") -> DataFrame:
    """Points inside any polygon, each once; MultiPoints cut down to their inside positions.

    ``key`` is unique in ``points``. MultiPoints without an inside position go.
    """
    each = points.select(F.col(key).alias("__k"), F.posexplode(coordinates(F.col(point))).alias("at", "p"))
    each = each.select("__k", "at", F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array("p"))).alias("parts"), F.lit(None).cast("array<double>").alias("bbox")).alias("geometry"))
    hit = _held(each, polygons, "geometry", polygon, False, "left_semi").select("point.__k", "point.at", only_position(F.col("point.geometry")).alias("p")).distinct()
    kept = hit.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("__ps"))
    joined = points.join(kept, points[key] == kept["__k"])
    left = F.transform("__ps", lambda x: x["p"])
    cut = F.when(F.col(f"{point}.type") == "MultiPoint", multi_point(left, F.col(f"{point}.bbox"))).otherwise(F.col(point))
    return joined.withColumn(point, cut).select(*points.columns)


FINE = 4  # cells along the side of a level's largest box, for pairs of boxes


def _fine(v: Column, level: Column) -> Column:
    return F.floor(v / (_size(level) / FINE))


def boxes_intersect(left: DataFrame, right: DataFrame, left_box: str = "bbox", right_box: str = "bbox") -> DataFrame:
    """All pairs of rows whose boxes meet, as structs ``left`` and ``right``.

    A pair is looked up at the larger of its levels, in the cell of the south-west corner of the
    overlap. In that cell one box begins from the west and one from the south: a box that begins
    in both ways meets all others, one that begins from the west only meets those that begin from
    the south only, and those that cover the cell's south-west corner meet no other of their kind.
    So a pair comes once, and the many boxes that lie over a cell aren't compared with each other.
    """

    def dealt(df: DataFrame, name: str, box: str, others: Column, kinds: tuple) -> DataFrame:
        b = F.col("box")
        own = df.select(F.struct("*").alias(name), F.col(box).alias("box")).filter("box IS NOT NULL").repartition("box")  # a small file may hold boxes of many cells
        own = own.withColumn("own", box_level(b)).withColumn("others", others)
        levels = F.concat(F.array("own"), F.filter("others", lambda k: k > F.col("own")))
        flat = own.select(name, "own", M.west(b).alias("w"), M.south(b).alias("s"), M.east(b).alias("e"), M.north(b).alias("n"), F.explode(levels).alias("level"))
        first = {"fx": _fine(F.col("w"), F.col("level")), "fy": _fine(F.col("s"), F.col("level"))}
        last = {"lx": F.greatest("fx", _fine(F.col("e"), F.col("level"))), "ly": F.greatest("fy", _fine(F.col("n"), F.col("level")))}
        celled = flat.withColumns(first).withColumns(last).withColumn("cx", F.explode(F.sequence("fx", "lx"))).withColumn("cy", F.explode(F.sequence("fy", "ly")))
        from_west, from_south = F.col("cx") == F.col("fx"), F.col("cy") == F.col("fy")
        both, west, south, over = (F.array(*map(F.lit, k)) for k in kinds)
        kind = F.when(from_west & from_south, both).when(from_west, west).when(from_south, south).otherwise(over)
        return celled.withColumn("kind", F.explode(kind)).select(name, "own", "w", "s", "e", "n", "level", "cx", "cy", "kind")

    # Kinds of pairs: 0 left begins both ways, 1 right does, 2 left from the west and right from the south, 3 the other way round.
    a_levels, b_levels = _levels(left, box_level(F.col(left_box))), _levels(right, box_level(F.col(right_box)))
    a = dealt(left, "left", left_box, b_levels, ((0,), (1, 2), (1, 3), (1,))).alias("a")
    b = dealt(right, "right", right_box, a_levels, ((0, 1), (0, 3), (0, 2), (0,))).alias("b")
    same = F.lit(True)
    for c in ("level", "cx", "cy", "kind"):
        same &= _ref("a", c) == _ref("b", c)
    meet = (_ref("a", "w") <= _ref("b", "e")) & (_ref("a", "e") >= _ref("b", "w")) & (_ref("a", "s") <= _ref("b", "n")) & (_ref("a", "n") >= _ref("b", "s"))
    # Files tell nothing of how many cells their boxes meet, so neither side is broadcast; a merge can spill.
    return a.join(b.hint("merge"), same & (_ref("a", "level") == F.greatest("a.own", "b.own")) & meet).select("a.left", "b.right")


def interval_lookup(keys: DataFrame, ranges: DataFrame, key: str, start: str, length: str, how: str = "left") -> DataFrame:
    """Join each key to the range [start, start + length) that holds it.

    Ranges are dealt to levels of doubling length, where each meets two blocks at most, and keys
    to the levels that occur, so neither a long range nor a full table lands in one task. With
    ranges that don't overlap a key meets one range or none. ``how`` is left, inner, left_semi
    or left_anti.
    """
    level = lambda n: F.when(n <= 1, 0).otherwise(F.ceil(F.log2(n.cast("double")))).cast("int")
    leveled = ranges.withColumn("__level", level(F.col(length)))
    block = lambda v, k: F.call_function("shiftright", v.cast("long"), k)
    last = F.col(start) + F.col(length) - 1
    dealt = leveled.withColumn("__block", F.explode(F.array_distinct(F.array(block(F.col(start), F.col("__level")), block(last, F.col("__level"))))))
    slim = keys.select(F.col(key).alias("__key")).filter("__key IS NOT NULL").distinct()
    looked = slim.withColumn("__l", F.explode(_levels(leveled, F.col("__level")))).withColumn("__b", block(F.col("__key"), F.col("__l")))
    met = looked.join(dealt, (F.col("__l") == F.col("__level")) & (F.col("__b") == F.col("__block")) & (F.col("__key") >= F.col(start)) & (F.col("__key") < F.col(start) + F.col(length)))
    found = met.select("__key", *ranges.columns)
    return keys.join(found, keys[key] == found["__key"], how).drop("__key")
