"""WGS84 and UTM arithmetic as SQL expressions (Krüger series, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import METRES_PER_DEGREE

# WGS84 ellipsoid and the UTM frame (public definitions).
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = (FLATTENING * (2 - FLATTENING)) ** 0.5
RADIUS = SCALE * SEMI_MAJOR_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

TERMS = 4


def _series(rows: list[list[float]]) -> list[float]:
    """Row j holds the coefficients of n^(j+1), n^(j+2), ... up to n^6.

    Terms past the fourth are below a tenth of a micrometre and only make the code longer.
    """
    return [sum(c * _N ** (j + 1 + k) for k, c in enumerate(row)) for j, row in enumerate(rows)][:TERMS]


# Sixth-order Krüger coefficients (Karney 2011).
FORWARD = _series([
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
])
INVERSE = _series([
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
])
LATITUDE = _series([
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675],
    [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [4279 / 630, -332 / 35, -399572 / 14175],
    [4174 / 315, -144838 / 6237],
    [601676 / 22275],
])


def _terms(coefficients: list[float], outer: str, inner: str | None, a: str, b: str = "") -> str:
    """Sum of c_j * outer(2j a) * inner(2j b) as SQL text; ``D`` keeps literals double."""
    parts = []
    for j, c in enumerate(coefficients, start=1):
        term = f"{c!r}D * {outer}({2 * j}D * {a})"
        parts.append(term + (f" * {inner}({2 * j}D * {b})" if inner else ""))
    return " + ".join(parts)


def _nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("nan")))


def _null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone that holds the point."""
    zone = ((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def central_meridian(epsg: Column) -> Column:
    return ((epsg % 100) * 6 - 183).cast("double")


def false_northing(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    Chained projections are merged and would repeat a series at every use, until the generated code is too long to
    compile; a one-row generator between them keeps each series in one place.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_utm(df: DataFrame, lat: str, lon: str, epsg: str, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Project ``lat``/``lon`` into the zone named by ``epsg``; adds two metre columns.

    Inside, a missing coordinate is NaN: without null checks the generated code is half as long.
    """
    phi = _nan(F.radians(F.col(lat)))
    out = _settled(df, _lam=_nan(F.radians(F.col(lon) - central_meridian(F.col(epsg)))),
                   _tau=F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi))))
    out = _settled(out, _xi=F.expr("atan2(_tau, cos(_lam))"),
                   _eta=F.expr("asinh(sin(_lam) / sqrt(_tau * _tau + cos(_lam) * cos(_lam)))"))
    out = _settled(out, **{
        easting: _null(F.expr(f"{FALSE_EASTING}D + {RADIUS!r}D * (_eta + {_terms(FORWARD, 'cos', 'sinh', '_xi', '_eta')})")),
        northing: _null(F.expr(f"{RADIUS!r}D * (_xi + {_terms(FORWARD, 'sin', 'cosh', '_xi', '_eta')})")) + false_northing(F.col(epsg))})
    return out.drop("_lam", "_tau", "_xi", "_eta")


def with_latlon(df: DataFrame, easting: str, northing: str, epsg: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Inverse of :func:`with_utm`."""
    out = _settled(df, _xi=_nan((F.col(northing) - false_northing(F.col(epsg))) / RADIUS), _eta=_nan((F.col(easting) - FALSE_EASTING) / RADIUS))
    out = _settled(out, _xp=F.expr(f"_xi - ({_terms(INVERSE, 'sin', 'cosh', '_xi', '_eta')})"),
                   _ep=F.expr(f"_eta - ({_terms(INVERSE, 'cos', 'sinh', '_xi', '_eta')})"))
    out = _settled(out, _chi=F.expr("asin(sin(_xp) / cosh(_ep))"), _arc=F.expr("degrees(atan2(sinh(_ep), cos(_xp)))"))
    out = _settled(out, **{lat: _null(F.expr(f"degrees(_chi + {_terms(LATITUDE, 'sin', None, '_chi')})")),
                           lon: central_meridian(F.col(epsg)) + _null(F.col("_arc"))})
    return out.drop("_xi", "_eta", "_xp", "_ep", "_chi", "_arc")


# --- grid geometry -------------------------------------------------------------------------
# Row 0 is north, column 0 is west; cell (size div 2, size div 2) is centred on the pin.

def edge_before(size: Column, res: Column) -> Column:
    """Metres from the pin to the north and to the west edge."""
    return (F.floor(size / 2) + 0.5) * res


def edge_after(size: Column, res: Column) -> Column:
    """Metres from the pin to the south and to the east edge."""
    return (size - F.floor(size / 2) - 0.5) * res


def total_area_m2(size: Column, res: Column) -> Column:
    return (size * res) * (size * res)


def cell_easting(origin_e: Column, col: Column, size: Column, res: Column) -> Column:
    return origin_e - edge_before(size, res) + (col + 0.5) * res


def cell_northing(origin_n: Column, row: Column, size: Column, res: Column) -> Column:
    return origin_n + edge_before(size, res) - (row + 0.5) * res


def fractional_col(easting: Column, origin_e: Column, size: Column, res: Column) -> Column:
    return (easting - (origin_e - edge_before(size, res))) / res


def fractional_row(northing: Column, origin_n: Column, size: Column, res: Column) -> Column:
    return ((origin_n + edge_before(size, res)) - northing) / res


def inspect_sizing(grid_size: Column, resolution_m: Column, extent_m: float, default_res: float,
                   low: int = 8, high: int = 512) -> tuple[Column, Column]:
    """Cells per side and metres per cell of an inspection grid that covers ``extent_m``."""
    asked = (
        F.when(resolution_m.isNotNull(), F.coalesce(grid_size, F.bround(F.lit(extent_m) / resolution_m, 0).cast("int")))
        .when(grid_size.isNotNull(), grid_size)
        .otherwise(F.bround(F.lit(extent_m / default_res), 0).cast("int"))
    )
    size = F.greatest(F.lit(low), F.least(F.lit(high), asked))
    return size, F.lit(extent_m) / size


# --- bilinear corner quad ------------------------------------------------------------------

def quad_point(u: Column, v: Column, corners: Column, part: str) -> Column:
    """``lat`` or ``lon`` at (u, v) of the quad nw-ne-se-sw."""
    def at(corner: str) -> Column:
        return corners.getField(corner).getField(part)
    top = at("nw") * (1 - u) + at("ne") * u
    bottom = at("sw") * (1 - u) + at("se") * u
    return top * (1 - v) + bottom * v


def with_quad_cell(df: DataFrame, lat: str, lon: str, corners: str, bounds: str, size: str,
                   row: str = "row", col: str = "col") -> DataFrame:
    """Point to cell through the corner quad: four Newton steps, null outside the quad."""
    c, b = F.col(corners), F.col(bounds)
    out = (
        df.withColumn("_u", (F.col(lon) - b["west"]) / (b["east"] - b["west"]))
        .withColumn("_v", (b["north"] - F.col(lat)) / (b["north"] - b["south"]))
    )
    h = 1e-4
    for _ in range(4):
        u, v = F.col("_u"), F.col("_v")
        out = (
            out.withColumn("_y", quad_point(u, v, c, "lat")).withColumn("_x", quad_point(u, v, c, "lon"))
            .withColumn("_yu", (quad_point(u + h, v, c, "lat") - F.col("_y")) / h)
            .withColumn("_xu", (quad_point(u + h, v, c, "lon") - F.col("_x")) / h)
            .withColumn("_yv", (quad_point(u, v + h, c, "lat") - F.col("_y")) / h)
            .withColumn("_xv", (quad_point(u, v + h, c, "lon") - F.col("_x")) / h)
            .withColumn("_det", F.col("_yu") * F.col("_xv") - F.col("_yv") * F.col("_xu"))
            .withColumn("_ey", F.col(lat) - F.col("_y")).withColumn("_ex", F.col(lon) - F.col("_x"))
            .withColumn("_du", F.when(F.abs("_det") < 1e-20, 0.0).otherwise(
                (F.col("_xv") * F.col("_ey") - F.col("_yv") * F.col("_ex")) / F.col("_det")))
            .withColumn("_dv", F.when(F.abs("_det") < 1e-20, 0.0).otherwise(
                (F.col("_yu") * F.col("_ex") - F.col("_xu") * F.col("_ey")) / F.col("_det")))
            .withColumn("_u", F.col("_u") + F.col("_du")).withColumn("_v", F.col("_v") + F.col("_dv"))
        )
    inside = F.col("_u").between(0, 1) & F.col("_v").between(0, 1)
    def index(x: str) -> Column:
        top = F.col(size) - 1
        return F.when(inside, F.greatest(F.lit(0), F.least(top, F.floor(F.col(x) * F.col(size)).cast("int"))))
    return out.withColumn(row, index("_v")).withColumn(col, index("_u")).drop(
        "_u", "_v", "_y", "_x", "_yu", "_xu", "_yv", "_xv", "_det", "_ey", "_ex", "_du", "_dv")


# --- bearings and currents -----------------------------------------------------------------

def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle bearing 0..360 of the leg; 0 when there is no leg."""
    d = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.coalesce(F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)), F.lit(0.0))


def current_east(speed: Column, heading_deg: Column, unit: str = "kmh") -> Column:
    return (speed if unit == "ms" else speed / 3.6) * F.sin(F.radians(heading_deg))


def current_north(speed: Column, heading_deg: Column, unit: str = "kmh") -> Column:
    return (speed if unit == "ms" else speed / 3.6) * F.cos(F.radians(heading_deg))


def heading_deg(u: Column, v: Column) -> Column:
    """Compass direction a vector points toward."""
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def degree_step(lat: Column, u: Column, v: Column, metres: Column) -> tuple[Column, Column]:
    """(lon, lat) change when moving ``metres`` along (u, v)."""
    speed = F.hypot(u, v)
    still = speed < 1e-9
    east = u * (metres / speed) / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    north = v * (metres / speed) / METRES_PER_DEGREE
    return F.when(still, 0.0).otherwise(east), F.when(still, 0.0).otherwise(north)
