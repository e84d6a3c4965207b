"""Units of measure over double columns in metres, square metres and degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measure import RADIUS


@dataclass(frozen=True)
class Unit:
    """A unit: its dimension, how many base units it has and its symbol."""

    kind: str
    factor: float
    symbol: str

    def __mul__(self, other: Unit) -> Unit:
        if self.kind != "length" or other.kind != "length":
            raise ValueError("only lengths multiply to an area")
        return Unit("area", self.factor * other.factor, f"{self.symbol}²" if self == other else f"{self.symbol}·{other.symbol}")

    def on(self, world: World) -> Unit:
        """The length that this rotation spans on a world's surface."""
        if self.kind != "rotation":
            raise ValueError("only a rotation spans a length")
        return Unit("length", math.radians(self.factor) * world.radius, self.symbol)


@dataclass(frozen=True)
class World:
    radius: float
    area_radius: float


EARTH = World(RADIUS, 6378137.0)

# fixed values: factors to the base unit
LENGTHS = {
    "millimeters": Unit("length", 0.001, "mm"),
    "centimeters": Unit("length", 0.01, "cm"),
    "meters": Unit("length", 1.0, "m"),
    "kilometers": Unit("length", 1000.0, "km"),
    "inches": Unit("length", 0.0254, "in"),
    "feet": Unit("length", 0.3048, "ft"),
    "yards": Unit("length", 0.9144, "yd"),
    "miles": Unit("length", 1609.344, "mi"),
    "links": Unit("length", 0.201168, "li"),
    "rods": Unit("length", 5.0292, "rd"),
    "chains": Unit("length", 20.1168, "ch"),
    "furlongs": Unit("length", 201.168, "fur"),
    "leagues": Unit("length", 4828.032, "lea"),
    "fathoms": Unit("length", 1.852, "ftm"),
    "cables": Unit("length", 185.2, "cable"),
    "nautical_miles": Unit("length", 1852.0, "nmi"),
}
AREAS = {
    "square_millimeters": Unit("area", 1e-6, "mm²"),
    "square_centimeters": Unit("area", 1e-4, "cm²"),
    "square_meters": Unit("area", 1.0, "m²"),
    "square_kilometers": Unit("area", 1e6, "km²"),
    "square_inches": Unit("area", 0.00064516, "in²"),
    "square_feet": Unit("area", 0.09290304, "ft²"),
    "square_yards": Unit("area", 0.83612736, "yd²"),
    "square_miles": Unit("area", 2589988.110336, "mi²"),
    "square_rods": Unit("area", 25.29285264, "rd²"),
    "acres": Unit("area", 4046.8564224, "acre"),
    "centiares": Unit("area", 1.0, "ca"),
    "deciares": Unit("area", 10.0, "da"),
    "ares": Unit("area", 100.0, "a"),
    "decares": Unit("area", 1000.0, "daa"),
    "hectares": Unit("area", 10000.0, "ha"),
}
ROTATIONS = {
    "radians": Unit("rotation", 180 / math.pi, "rad"),
    "gradians": Unit("rotation", 0.9, "gon"),
    "degrees": Unit("rotation", 1.0, "°"),
    "arc_minutes": Unit("rotation", 1 / 60, "′"),
    "arc_seconds": Unit("rotation", 1 / 3600, "″"),
}
EARTH_LENGTHS = {f"earth_{k}": u.on(EARTH) for k, u in ROTATIONS.items()}
UNITS = LENGTHS | AREAS | ROTATIONS | EARTH_LENGTHS
COMPASS = {
    name: 22.5 * k
    for k, name in enumerate(
        "north north_northeast northeast east_northeast east east_southeast southeast south_southeast south south_southwest southwest west_southwest west west_northwest northwest north_northwest".split()
    )
}
ZERO, MAX_VALUE, MIN_VALUE = 0.0, 1.7976931348623157e308, 5e-324
POSITIVE_INFINITY, NEGATIVE_INFINITY = math.inf, -math.inf


def unit(u: Unit | str) -> Unit:
    return UNITS[u] if isinstance(u, str) else u


def to_base(x: Column, u: Unit | str) -> Column:
    return x * F.lit(unit(u).factor)


def from_base(x: Column, u: Unit | str) -> Column:
    return x / F.lit(unit(u).factor)


def convert(x: Column, from_: Unit | str, to: Unit | str) -> Column:
    a, b = unit(from_), unit(to)
    if a.kind != b.kind:
        raise ValueError(f"{a.kind} isn't {b.kind}")
    return x * F.lit(a.factor) / F.lit(b.factor)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def to_float(x: Column, u: Unit | str) -> Column:
    return from_base(x, u).cast("float")


def round_to_long(x: Column, u: Unit | str) -> Column:
    return round_half_up(from_base(x, u)).cast("long")


def round_to_int(x: Column, u: Unit | str) -> Column:
    return round_half_up(from_base(x, u)).cast("int")


def remainder(a: Column, b: Column) -> Column:
    """Of truncated division: has the sign of a."""
    return a % b


def modulo(a: Column, b: Column) -> Column:
    """Of floored division: has the sign of b."""
    return a - b * F.floor(a / b)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_positive(x: Column) -> Column:
    return x > 0


def is_negative(x: Column) -> Column:
    return x < 0


def is_zero(x: Column) -> Column:
    return x == 0


def sum_of(x: Column) -> Column:
    """Aggregate: a sum that is 0 over no rows."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def tan(x: Column) -> Column:
    return F.tan(F.radians(x))


def asin(x: Column) -> Column:
    return F.degrees(F.asin(x))


def acos(x: Column) -> Column:
    return F.degrees(F.acos(x))


def atan(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


# bearings: degrees clockwise from north, in [0, 360)


def bearing_of(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def bearing_plus(b: Column, rotation: Column) -> Column:
    return bearing_of(b + rotation)


def bearing_minus(b: Column, other: Column) -> Column:
    """The clockwise rotation from the other bearing."""
    return bearing_of(b - other)


def clockwise_rotation(a: Column, b: Column) -> Column:
    return bearing_of(b - a)


def smallest_rotation(a: Column, b: Column) -> Column:
    turn = clockwise_rotation(a, b)
    return F.when(turn > 180, turn - 360).otherwise(turn)


# text


def _fixed(x: Column, places: int) -> Column:
    scale = 10**places
    return F.format_string(f"%.{places}f", F.floor(x * scale + 0.5) / scale)


def format_unit(x: Column, u: Unit | str, places: int = 2) -> Column:
    """A base value in a unit, with its symbol; a symbol of one sign stands without a blank."""
    own = unit(u)
    gap = "" if len(own.symbol) == 1 and not own.symbol.isalpha() else " "
    return F.concat(_fixed(from_base(x, own), places), F.lit(gap + own.symbol))


def format_dms(x: Column, places: int = 2) -> Column:
    """Degrees, minutes and seconds."""
    size = F.abs(x)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    seconds = ((size - whole) * 60 - minutes) * 60
    return F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("° "), minutes.cast("string"), F.lit("′ "), _fixed(seconds, places), F.lit("″"))


def _quadrant(b: Column, text) -> Column:
    """North or south, the angle from it, and east or west."""
    ns = F.when((b <= 90) | (b >= 270), "N").otherwise("S")
    ew = F.when(b <= 180, "E").otherwise("W")
    angle = F.when(b < 90, b).when(b == 90, 90.0).when(b <= 180, 180 - b).when(b < 270, b - 180).otherwise(360 - b)
    return text(ns, ew, angle)


def format_bearing(b: Column, places: int = 2) -> Column:
    """Quadrant notation; east and west are a quarter turn from south, and north is N 0 E."""
    ns = F.when((b < 90) | (b > 270), "N").otherwise("S")
    return _quadrant(b, lambda _, ew, a: F.concat(ns, F.lit(" "), _fixed(a, places), F.lit("° "), ew))


def format_bearing_dms(b: Column, places: int = 2) -> Column:
    ns = F.when((b < 90) | (b > 270), "N").otherwise("S")
    return _quadrant(b, lambda _, ew, a: F.concat(ns, F.lit(" "), format_dms(a, places), F.lit(" "), ew))
