"""The same results as plain SQL over the driver tables, for checking.

Written from the definitions: self joins and recursion where the Spark side uses windows,
slices or array arithmetic.
"""

from __future__ import annotations

from ..functions import geo
from ..operators import report

ORACLES: dict[str, str] = {}
EIGHT = "(VALUES (-1,-1,0),(-1,0,1),(-1,1,2),(0,-1,3),(0,1,5),(1,-1,6),(1,0,7),(1,1,8)) AS o(dr, dc, idx)"
NINE = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) AS o(dr, dc)"


def r(expr: str, digits: int, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr.split('.')[-1]}"


def _num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def _series(coefs, outer, inner, a, b=""):
    return " + ".join(f"{_num(c)} * {outer}({2 * j} * {a})" + (f" * {inner}({2 * j} * {b})" if inner else "") for j, c in enumerate(coefs, 1))


def utm(src: str, lat: str, lon: str, e: str = "easting", n: str = "northing", epsg: str = "epsg") -> str:
    """Sub-select with the projected point (northern hemisphere data)."""
    ecc, k = _num(geo.ECCENTRICITY), _num(geo.RADIUS)
    return f"""(SELECT * EXCLUDE (_lam, _tau, _xi, _eta), 500000e0 + {k} * (_eta + {_series(geo.FORWARD, 'cos', 'sinh', '_xi', '_eta')}) AS {e},
      {k} * (_xi + {_series(geo.FORWARD, 'sin', 'cosh', '_xi', '_eta')}) AS {n}
    FROM (SELECT *, atan2(_tau, cos(_lam)) AS _xi, asinh(sin(_lam) / sqrt(_tau * _tau + cos(_lam) * cos(_lam))) AS _eta
    FROM (SELECT *, sinh(atanh(sin(radians({lat}))) - {ecc} * atanh({ecc} * sin(radians({lat})))) AS _tau
    FROM (SELECT *, radians({lon} - (({epsg} % 100) * 6 - 183)) AS _lam FROM {src}))))"""


def latlon(src: str, e: str = "easting", n: str = "northing", lat: str = "lat", lon: str = "lon") -> str:
    k = _num(geo.RADIUS)
    return f"""(SELECT * EXCLUDE (_xi, _eta, _xp, _ep, _chi), degrees(_chi + {_series(geo.LATITUDE, 'sin', None, '_chi')}) AS {lat},
      ((epsg % 100) * 6 - 183) + degrees(atan2(sinh(_ep), cos(_xp))) AS {lon}
    FROM (SELECT *, asin(sin(_xp) / cosh(_ep)) AS _chi
    FROM (SELECT *, _xi - ({_series(geo.INVERSE, 'sin', 'cosh', '_xi', '_eta')}) AS _xp, _eta - ({_series(geo.INVERSE, 'cos', 'sinh', '_xi', '_eta')}) AS _ep
    FROM (SELECT *, ({n}) / {k} AS _xi, (({e}) - 500000e0) / {k} AS _eta FROM {src}))))"""


MISSIONS = """missions AS (SELECT CAST(s_suppkey AS BIGINT) AS mission_id, 32.7940e0 + 0.05e0 * (s_nationkey % 5) AS lkp_lat,
  34.9896e0 + 0.002e0 * s_nationkey AS lkp_lon, 32 AS size, 50e0 AS res_m, s_suppkey % 11 = 0 AS wet,
  CASE WHEN s_suppkey % 11 = 0 THEN 44 ELSE 8 END AS shore, 20 + s_suppkey % 60 AS age, 1 + s_suppkey % 5 AS fitness, s_suppkey % 7 = 0 AS injured,
  s_suppkey % 11 <> 0 AS topography, s_suppkey % 11 <> 0 AND s_suppkey % 2 = 0 AS roads, s_suppkey % 11 <> 0 AND s_suppkey % 3 = 0 AS personality,
  s_suppkey % 11 <> 0 AND s_suppkey % 5 = 0 AS weather FROM supplier)"""
PINS = f"{MISSIONS}, pins AS (SELECT * FROM {utm('(SELECT *, 32600 + CAST(floor((lkp_lon + 180) / 6) AS INT) + 1 AS epsg FROM missions)', 'lkp_lat', 'lkp_lon', 'origin_e', 'origin_n')})"
CELLS = f"""{PINS}, axis AS (SELECT CAST(range AS INT) AS i FROM range(32)),
 cells AS (SELECT p.*, a.i AS "row", b.i AS col, a.i = 16 AND b.i = 16 AS is_pin, CASE WHEN a.i = 16 AND b.i = 16 THEN 1e0 ELSE 0e0 END AS p,
   origin_e - 825e0 + (b.i + 0.5e0) * 50e0 AS easting, origin_n + 825e0 - (a.i + 0.5e0) * 50e0 AS northing FROM pins p, axis a, axis b)"""
RELIEF = f"""{CELLS}, relief AS (SELECT *, CAST(CASE WHEN "row" + col < shore THEN 0 ELSE 20 + ("row" * 13 + col * 7 + mission_id * 5) % 23
   + CASE WHEN col >= 20 THEN 70 ELSE 0 END + CASE WHEN col >= 26 THEN 120 ELSE 0 END END AS DOUBLE) AS elevation FROM cells)"""


def gradient(src: str, out: str) -> str:
    """Central differences through self joins."""
    return f"""{out}_g AS (SELECT c.*, (e.elevation - w.elevation) / ((e.col - w.col) * c.res_m) AS gx, (s.elevation - n.elevation) / ((s."row" - n."row") * c.res_m) AS gy
  FROM {src} c
  JOIN {src} e ON e.mission_id = c.mission_id AND e."row" = c."row" AND e.col = least(c.col + 1, c.size - 1)
  JOIN {src} w ON w.mission_id = c.mission_id AND w."row" = c."row" AND w.col = greatest(c.col - 1, 0)
  JOIN {src} s ON s.mission_id = c.mission_id AND s.col = c.col AND s."row" = least(c."row" + 1, c.size - 1)
  JOIN {src} n ON n.mission_id = c.mission_id AND n.col = c.col AND n."row" = greatest(c."row" - 1, 0)),
 {out} AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS slope, -gx / (sqrt(gx * gx + gy * gy) + 1e-8) AS aspect_e, -gy / (sqrt(gx * gx + gy * gy) + 1e-8) AS aspect_n,
   elevation > 1 AS is_land FROM {out}_g)"""


TERRAIN = f"{RELIEF}, {gradient('relief', 'terrain')}"
PROX = """exp(-(least(abs("row" - 16), abs(col - 16)) * 50e0) / 20e0)"""
COSTED = f"""{TERRAIN}, costed AS (SELECT *, greatest(CASE WHEN on_road THEN 1e0 ELSE 4e0 END, CASE WHEN degrees(slope) >= 30 THEN 8e0 ELSE 0e0 END,
   CASE WHEN NOT is_land THEN 20e0 ELSE 0e0 END, 0.5e0) AS cost FROM (SELECT *, is_land AND {PROX} >= exp(-4e0) AS on_road FROM terrain))"""
FORMULA = f"""{CELLS}, shape AS (SELECT * EXCLUDE (p, v), CASE WHEN v < 20 THEN 0 ELSE v END / (1e0 + abs("row" - 16) + abs(col - 16)) AS p
   FROM (SELECT *, ("row" * 31 + col * 17 + mission_id * 7) % 101 AS v FROM cells)),
 surf AS (SELECT * EXCLUDE (p), p / sum(p) OVER (PARTITION BY mission_id) AS p FROM shape)"""
EVENTS = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
DETECTIONS = f"""{PINS}, {EVENTS}, det AS (SELECT m.*, e.event_id, e.user_id, e.ts, e.us, e.event_type = 'purchase' AS person, least(e.value / 100, 1e0) AS confidence, e.event_id % 1000 AS frame,
   m.lkp_lat + ((e.event_id * 104729) % 1601 - 800) / 111320e0 AS lat, m.lkp_lon + ((e.event_id * 7919) % 1601 - 800) / (111320e0 * cos(radians(m.lkp_lat))) AS lon
   FROM ev e JOIN missions0 m ON m.mission_id = CAST(floor(e.user_id * 2 / 3) AS BIGINT))""".replace("missions0", "pins")
PLACED = f"""{DETECTIONS}, placed AS (SELECT *, (origin_n + 825e0 - point_n) / 50e0 AS row_f, (point_e - (origin_e - 825e0)) / 50e0 AS col_f FROM {utm('det', 'lat', 'lon', 'point_e', 'point_n')}),
 onto AS (SELECT *, CAST(floor(row_f) AS INT) AS "row", CAST(floor(col_f) AS INT) AS col FROM placed WHERE floor(row_f) BETWEEN 0 AND 31 AND floor(col_f) BETWEEN 0 AND 31),
 timed AS MATERIALIZED (SELECT *, CAST(floor((us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) + 1 AS BIGINT) AS tick FROM onto)"""
KEYS = 'mission_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col'


def oracle(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {ctes} {body}" if ctes else body


# --- geometry
META = f"""{PINS}, ext AS (SELECT *, origin_e - 825e0 AS min_e, origin_e + 775e0 AS max_e, origin_n - 775e0 AS min_n, origin_n + 825e0 AS max_n, 2560000e0 AS area_m2 FROM pins),
 meta AS (SELECT *, greatest(nw_lat, ne_lat, se_lat, sw_lat) AS north, least(nw_lat, ne_lat, se_lat, sw_lat) AS south, greatest(nw_lon, ne_lon, se_lon, sw_lon) AS east,
   least(nw_lon, ne_lon, se_lon, sw_lon) AS west FROM {latlon(latlon(latlon(latlon('ext', 'min_e', 'max_n', 'nw_lat', 'nw_lon'), 'max_e', 'max_n', 'ne_lat', 'ne_lon'), 'max_e', 'min_n', 'se_lat', 'se_lon'), 'min_e', 'min_n', 'sw_lat', 'sw_lon')})"""
_corner = ", ".join(r(f"{c}_{p}", 8) for c in ("nw", "ne", "se", "sw") for p in ("lat", "lon"))
oracle("grid_metadata", META, f"SELECT mission_id, CAST(epsg AS BIGINT) AS epsg, {', '.join(r(c, 4) for c in ('origin_e', 'origin_n', 'min_e', 'max_e', 'min_n', 'max_n'))}, {r('area_m2', 2)}, {_corner}, {', '.join(r(c, 8) for c in ('north', 'south', 'east', 'west'))} FROM meta")
oracle("grid_cells", CELLS, f"SELECT {KEYS}, {r('easting', 3)}, {r('northing', 3)}, {r('lat', 8)}, {r('lon', 8)}, {r('p', 1)} FROM {latlon('cells')}")
oracle("utm_roundtrip", DETECTIONS, f"SELECT event_id, {r('easting', 3)}, {r('northing', 3)}, {r('lat', 7, 'lat2')}, {r('lon', 7, 'lon2')} FROM {utm('det', 'lat', 'lon')}")
oracle("point_to_cell", PLACED, f"SELECT event_id, {KEYS}, {r('row_f', 4)}, {r('col_f', 4)} FROM onto")
oracle("point_to_cell_clamped", PLACED, """SELECT event_id, mission_id, CAST(greatest(0, least(31, floor(row_f))) AS BIGINT) AS "row", CAST(greatest(0, least(31, floor(col_f))) AS BIGINT) AS col FROM placed""")


def quad(part: str, u: str = "u", v: str = "v") -> str:
    return f"((nw_{part} * (1 - {u}) + ne_{part} * {u}) * (1 - {v}) + (sw_{part} * (1 - {u}) + se_{part} * {u}) * {v})"


oracle("quad_cell_latlon", f"{META}, axis AS (SELECT CAST(range AS INT) AS i FROM range(32)), q AS (SELECT m.*, a.i AS \"row\", b.i AS col, (b.i + 0.5e0) / 32 AS u, (a.i + 0.5e0) / 32 AS v FROM meta m, axis a, axis b)",
       f"SELECT {KEYS}, {r(quad('lat'), 8, 'lat')}, {r(quad('lon'), 8, 'lon')} FROM q")
_step = "(SELECT m.*, d.event_id, d.lat AS plat, d.lon AS plon, (d.lon - west) / (east - west) AS u, (north - d.lat) / (north - south) AS v FROM meta m JOIN det d USING (mission_id))"
for _ in range(4):
    _step = f"""(SELECT * EXCLUDE (u, v, yu, xu, yv, xv, ey, ex), u + (xv * ey - yv * ex) / (yu * xv - yv * xu) AS u, v + (yu * ex - xu * ey) / (yu * xv - yv * xu) AS v FROM
    (SELECT *, ({quad('lat', '(u + 1e-4)')} - {quad('lat')}) / 1e-4 AS yu, ({quad('lon', '(u + 1e-4)')} - {quad('lon')}) / 1e-4 AS xu, ({quad('lat', 'u', '(v + 1e-4)')} - {quad('lat')}) / 1e-4 AS yv,
      ({quad('lon', 'u', '(v + 1e-4)')} - {quad('lon')}) / 1e-4 AS xv, plat - {quad('lat')} AS ey, plon - {quad('lon')} AS ex FROM {_step}))"""
oracle("quad_point_cell", f"{META}, {DETECTIONS[len(PINS) + 2:]}", f"""SELECT event_id, CASE WHEN ok THEN CAST(least(31, floor(v * 32)) AS BIGINT) END AS "row", CASE WHEN ok THEN CAST(least(31, floor(u * 32)) AS BIGINT) END AS col
  FROM (SELECT *, u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AS ok FROM {_step})""")
oracle("inspect_sizing", "", f"""SELECT p_partkey, CAST(size AS BIGINT) AS size, {r('6400e0 / size', 8, 'resolution_m')} FROM (SELECT p_partkey, greatest(8, least(512,
  CASE WHEN p_partkey % 4 = 0 THEN coalesce(asked, CAST(round_even(6400e0 / (p_retailprice / 50), 0) AS INT)) WHEN asked IS NOT NULL THEN asked ELSE 256 END)) AS size
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_size * 20 END AS asked FROM part))""")

# --- scalars
oracle("mission_clock", "o AS (SELECT *, (0.5e0 + o_orderkey % 40 / 4e0) * 10 AS step, o_custkey % 9 AS tick FROM orders)", f"""SELECT o_orderkey, CAST(floor(o_custkey * 3600e0 / step) AS BIGINT) AS n_ticks, CAST(tick AS BIGINT) AS tick,
  CAST(epoch_us(TIMESTAMP '2024-01-01') + tick * step * 1e6 AS BIGINT) AS clock_us,
  CAST(CASE WHEN tick = 0 THEN 0 WHEN tick < 3 THEN greatest(1, round_even(full_steps * (tick / 3e0), 0)) ELSE full_steps END AS BIGINT) AS diffusion_steps,
  CAST(least(96, 2 * greatest(1, tick * 10)) AS BIGINT) AS drift_steps,
  CASE WHEN s >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{{:d}}:{{:02d}}', s // 60, s % 60) END AS duration,
  format('{{:02d}}:{{:02d}}:{{:06.3f}}', CAST(floor(vt / 3600) AS BIGINT), CAST(floor(vt % 3600 / 60) AS BIGINT), vt % 3600 % 60) AS video_ts,
  {r('step', 4, 'step_sec')}, {r('greatest(0, tick - 3) * step', 4, 'live_sec')}, {r('(tick + 1) * step / 3600', 8, 'horizon_h')}, {r('(tick + 1) * step / 3600 + o_custkey', 8, 'live_horizon_h')}
  FROM (SELECT *, least(18, greatest(1, round_even(6 * 0.88e0 * greatest(step, 1) / 60, 0))) AS full_steps, CAST(floor(o_custkey * 7.9e0) AS BIGINT) AS s, o_orderkey / 30e0 AS vt FROM o)""")
oracle("mission_ticks", "", "SELECT c_custkey AS mission_id, CAST(t AS BIGINT) AS tick FROM (SELECT c_custkey, unnest(range(0, c_custkey % 7 + 1)) AS t FROM customer)")
oracle("mobility", "", f"""SELECT c_custkey, format('{{:.2f}} m/s toward {{:.0f}}° ({{}})', abs(round(c_acctbal, 0)) / 4, CAST(c_custkey % 360 AS DOUBLE), CASE WHEN c_custkey % 2 = 0 THEN 'Open-Meteo' ELSE 'fallback' END) AS summary,
  {r('greatest(0.35e0, least(1.2e0, 1.2e0 - (1 + c_custkey % 120 - 10) / 100e0)) * (0.85e0 + 0.1e0 * (c_custkey % 5)) * CASE WHEN c_custkey % 7 = 0 THEN 0.45e0 ELSE 1e0 END', 8, 'mobility')},
  {r('4.2e0 / exp(-3.5e0 * 0.05e0) * exp(-3.5e0 * abs(c_acctbal / 5000 + 0.05e0))', 8, 'speed_kmh')} FROM customer""")
oracle("text_lists", "t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat_ws(',', ' ' || (c_custkey % 90), CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE CAST(c_custkey % 11 AS VARCHAR) END, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '7.5' END) END AS t, CASE WHEN c_custkey % 5 = 0 THEN 33e0 END AS f FROM customer), "
       "l AS (SELECT *, string_split(t, ',') AS s, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) END AS conf FROM t), "
       "d AS (SELECT *, CASE WHEN k % 8 = 0 THEN [1e0, 2e0] WHEN len(conf) > 0 THEN CASE WHEN f IS NULL THEN conf ELSE list_concat([f], conf[2:]) END ELSE [coalesce(f, 120e0)] END AS lau FROM l)",
       """SELECT k AS c_custkey, CAST(len(list_filter(s, lambda x: trim(x) <> '')) AS BIGINT) AS parts, CAST(len(conf) AS BIGINT) AS n_delays, CASE WHEN len(s) >= 2 THEN coalesce(TRY_CAST(trim(s[2]) AS DOUBLE), 0e0) END AS off2,
  CASE WHEN len(s) >= 3 THEN coalesce(TRY_CAST(trim(s[3]) AS DOUBLE), 0e0) END AS off3, lau[1] AS launch1, lau[2] AS launch2, lau[3] AS launch3 FROM d""")
oracle("resolve_layers", "f AS (SELECT c_custkey AS k, c_custkey % 13 <> 0 AS given, c_custkey % 2 = 0 AS t, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 = 0 END AS rd, c_custkey % 5 = 0 AS pe, c_custkey % 17 <> 0 AS dry FROM customer)",
       """SELECT k AS c_custkey, CAST(dry AND (NOT given OR t OR NOT (t OR coalesce(rd, false) OR pe)) AS BIGINT) AS topography, CAST(dry AND (NOT given OR coalesce(rd, true)) AS BIGINT) AS roads,
  CAST(dry AND given AND pe AS BIGINT) AS personality, CAST(0 AS BIGINT) AS weather, CAST(NOT dry AS BIGINT) AS sea_drift FROM f""")
oracle("validate_missions", """q AS (SELECT c_custkey AS k, c_custkey % 19 = 0 AS far, CASE WHEN c_custkey % 2 = 0 THEN 'offline' ELSE 'live' END AS mode, c_custkey % 4 = 0 OR c_custkey % 5 <> 0 AS has_ts,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 5 - 1 END AS start_min, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 300 AS DOUBLE) ELSE 1e0 END AS pace, c_custkey % 3 = 0 AS personal,
  CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 130 END AS age0, CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 7 END AS fit0 FROM customer)""",
       f"""SELECT k AS c_custkey, CAST(CASE WHEN personal THEN coalesce(age0, 35) ELSE age0 END AS BIGINT) AS age, CAST(CASE WHEN personal THEN coalesce(fit0, 3) ELSE fit0 END AS BIGINT) AS fitness, mode,
  CASE WHEN far THEN 'lkp out of range' WHEN pace NOT BETWEEN 0.1 AND 120 THEN 'pace out of range' WHEN age0 NOT BETWEEN 1 AND 120 THEN 'age out of range' WHEN fit0 NOT BETWEEN 1 AND 5 THEN 'fitness out of range'
   WHEN mode = 'offline' AND NOT has_ts THEN 'lkp_timestamp is required for offline mode' WHEN mode = 'offline' AND start_min < 0 THEN 'simulation start before lkp_timestamp' END AS reason, {r('pace * 10', 4, 'step_sec')} FROM q""")

# --- detections and telemetry
oracle("normalize_detections", DETECTIONS, f"""SELECT event_id, us AS ts, CAST(CASE WHEN event_id % 3 = 2 THEN false ELSE person END AS BIGINT) AS person, CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 1000 END AS BIGINT) AS frame,
  CASE WHEN event_id % 4 = 0 THEN CAST(4 AS BIGINT) END AS n_box, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 7 AS DOUBLE) END AS box3,
  {r('CASE WHEN event_id % 5 <> 0 THEN lat END', 6, 'lat')}, {r('CASE WHEN event_id % 5 <> 0 THEN lon END', 6, 'lon')}, {r('CASE WHEN event_id % 3 < 2 THEN event_id % 500 END', 3, 'alt')},
  {r('conf', 6, 'confidence')}, {r('CASE WHEN event_id % 4 = 1 THEN 100 ELSE least(100, conf * 100) END', 4, 'confidence_percent')}
  FROM (SELECT *, CASE WHEN event_id % 6 = 0 THEN 0e0 ELSE least(1e0, round(confidence * 1.25e0, 6)) END AS conf FROM det) WHERE event_id % 97 <> 0""")
oracle("person_split", DETECTIONS, f"""SELECT event_id, CAST(person AS BIGINT) AS person, {r('CASE WHEN ok THEN la END', 7, 'lat')}, {r('CASE WHEN ok THEN lon END', 7, 'lon')} FROM
  (SELECT *, la BETWEEN -90 AND 90 AS ok FROM (SELECT *, lat + CASE WHEN event_id % 31 = 0 THEN 90 ELSE 0 END + 60 / 111320e0 AS la FROM det))""")


def sessions_of(src: str, tie: str, gap_us: int = 21600000000) -> str:
    return f"""(SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us, {tie} ROWS UNBOUNDED PRECEDING) AS session FROM
  (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, {tie}) <= {gap_us} THEN 0 ELSE 1 END AS n FROM {src}))"""


oracle("sessions", EVENTS, f"SELECT event_id, user_id, CAST(session AS BIGINT) AS session FROM {sessions_of('ev', 'event_id')}")
TELE = f"{EVENTS}, tele AS (SELECT * FROM ev WHERE event_type IN ('view', 'click')), mdet AS (SELECT * FROM ev WHERE event_type IN ('purchase', 'signup'))"
CHOSEN = f"""{TELE}, ses AS (SELECT * FROM {sessions_of('mdet', 'event_id')}), flight AS (SELECT user_id, arg_min(us, event_id) AS f0, arg_max(us, event_id) AS f1 FROM tele GROUP BY 1),
 sb AS (SELECT s.user_id, session, min(us) AS s0, max(us) AS s1, count(*) AS n, any_value(f0) AS f0, any_value(f1) AS f1 FROM ses s JOIN flight USING (user_id) GROUP BY 1, 2),
 chosen AS (SELECT *, s0 - f0 AS off FROM sb QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs((s1 - s0) - (f1 - f0)), s0) = 1)"""
oracle("session_match", CHOSEN, "SELECT user_id, CAST(session AS BIGINT) AS session, CAST(n AS BIGINT) AS session_rows, off AS offset_us FROM chosen")


def near(left: str, right: str, tol: int, later: bool) -> str:
    """All candidates within the tolerance, the nearest kept."""
    order = "DESC" if later else "ASC"
    return f"""(SELECT l.event_id, l.user_id, l.us, t.event_id AS sample, abs(t.us - l.us) AS gap FROM {left} l LEFT JOIN {right} t ON t.user_id = l.user_id AND t.us BETWEEN l.us - {tol} AND l.us + {tol}
  QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(t.us - l.us) NULLS LAST, t.us {order}) = 1)"""


oracle("attach_gps", TELE, f"SELECT n.event_id AS source_index, n.user_id, {r('e.value', 6, 'latitude')}, {r('e.value / 2', 6, 'longitude')} FROM {near('mdet', 'tele', 7200000000, True)} n LEFT JOIN events e ON e.event_id = n.sample")
oracle("asof_nearest", TELE, f"SELECT event_id AS source_index, user_id, sample, round(gap / 1e6, 6) AS gap_sec FROM {near('mdet', 'tele', 7200000000, True)}")
CLAIM = "(SELECT *, CASE WHEN sample IS NOT NULL AND row_number() OVER (PARTITION BY user_id, sample ORDER BY us, event_id) = 1 THEN sample END AS won FROM {})"
oracle("asof_claim", TELE, f"SELECT event_id AS source_index, user_id, won AS sample FROM {CLAIM.format(near('mdet', 'tele', 7200000000, False))}")
MERGED = f"""{CHOSEN}, ali AS (SELECT t.* EXCLUDE (us), t.us AS src_us, t.us + off AS us FROM tele t JOIN chosen USING (user_id)), pick AS (SELECT s.* FROM ses s JOIN chosen c ON c.user_id = s.user_id AND c.session = s.session),
 cl AS (SELECT * FROM {CLAIM.format(near('pick', 'ali', 7200000000, False))} WHERE won IS NOT NULL), mrg AS (SELECT a.*, c.event_id AS did FROM ali a LEFT JOIN cl c ON c.won = a.event_id)"""
_iso = "strftime(make_timestamp(CAST(floor({} / 1000) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
oracle("merge_flights", MERGED, f"""SELECT m.user_id, m.event_id AS source_index, {_iso.format('m.us')} AS "timestamp", {_iso.format('m.src_us')} AS source_timestamp, CAST(coalesce(d.event_type = 'purchase', false) AS BIGINT) AS person_found,
  CAST(d.event_id % 1000 AS BIGINT) AS frame, CASE WHEN d.event_type = 'purchase' THEN d.value END AS box2, {r('m.value * 0.3048e0', 6, 'altitude')}, {r("CASE WHEN d.event_type = 'purchase' THEN least(d.value / 100, 1e0) END", 6, 'confidence')},
  {r("coalesce(CASE WHEN d.event_type = 'purchase' THEN least(d.value / 100, 1e0) * 100 END, 0)", 4, 'confidence_percent')} FROM mrg m LEFT JOIN ev d ON d.event_id = m.did""")
oracle("merge_report", f"""{MERGED}, tot AS (SELECT user_id, count(*) AS j, count(*) - count(DISTINCT us) AS jd FROM mdet GROUP BY 1), tc AS (SELECT user_id, count(*) AS c, count(*) - count(DISTINCT us) AS cd FROM tele GROUP BY 1),
 mm AS (SELECT user_id, count(did) AS k FROM mrg GROUP BY 1),
 er AS (SELECT user_id, count(*) FILTER (event_id % 3 = 2 AND event_id % 2 = 1) AS nf, count(*) FILTER (event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id % 9 <> 0)) AS bj,
  count(*) FILTER (event_id % 3 = 1 AND event_id % 2 = 0) AS bc, count(*) FILTER (event_id % 3 = 2 AND event_id % 2 = 0) AS bn FROM events WHERE event_type = 'error' GROUP BY 1)""", f"""SELECT c.user_id, CAST(c.n AS BIGINT) AS selected_json_records, strftime(make_timestamp(c.s0), '%Y-%m-%dT%H:%M:%S.%f') AS selected_session_start, CAST(j AS BIGINT) AS total_json_records, CAST(tc.c AS BIGINT) AS total_csv_rows,
  CAST(k AS BIGINT) AS matched_records, CAST(jd AS BIGINT) AS duplicate_json_timestamps, CAST(cd AS BIGINT) AS duplicate_csv_timestamps, CAST(j - k AS BIGINT) AS unmatched_json_records, CAST(c.n - k AS BIGINT) AS unmatched_selected_json_records,
  CAST(j - c.n AS BIGINT) AS unselected_json_records, CAST(tc.c - k AS BIGINT) AS unmatched_csv_rows, coalesce(nf, 0) AS not_found_csv_rows, coalesce(bj, 0) AS malformed_json_timestamps, coalesce(bc, 0) AS malformed_csv_timestamps,
  coalesce(bn, 0) AS malformed_not_found_csv_timestamps, {r('c.off / 1e6', 6, 'clock_offset_seconds')} FROM chosen c JOIN tot USING (user_id) JOIN tc USING (user_id) JOIN mm USING (user_id) LEFT JOIN er USING (user_id)""")
oracle("json_arrays", TELE, "SELECT user_id, CAST(us // 86400000000 AS BIGINT) AS bucket, count(*) AS n, min(us) AS first_us, CAST(sum(event_id) AS BIGINT) AS ids FROM tele GROUP BY 1, 2")
oracle("array_elements", TELE, """SELECT user_id || '/' || us // 86400000000 AS source_path, row_number() OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us, event_id) - 1 AS place, event_id AS source_index,
  CAST(length('{"' || event_id || '": "\\\\"}]') AS BIGINT) AS note_chars FROM tele""")
oracle("gps_track", EVENTS, f"SELECT user_id, event_id, us // 10000 * 10000 AS ts, {r('value', 6, 'lat')}, {r('value / 4', 6, 'lon')} FROM ev WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND NOT (value = 0)")
oracle("best_detection", "b AS (SELECT event_id // 3 AS frame, event_id, value, event_type IN ('purchase', 'click', 'view') AND value / 97 >= 0.5 AS good FROM events), g AS (SELECT * FROM b WHERE good QUALIFY row_number() OVER (PARTITION BY frame ORDER BY value DESC, event_id) = 1)",
       f"SELECT CAST(f.frame AS BIGINT) AS frame, CAST(g.event_id IS NOT NULL AS BIGINT) AS person, CAST(g.event_id AS DOUBLE) AS box2, {r('g.value / 97', 3, 'confidence')} FROM (SELECT DISTINCT frame FROM b) f LEFT JOIN g USING (frame)")
oracle("clip_summary", "", f"SELECT event_id % 4 AS clip, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS found, count(*) AS processed, {r('''100e0 * count(*) FILTER (event_type = 'purchase') / count(*)''', 6, 'percent')} FROM events GROUP BY 1")
oracle("carry_boxes", "", f"SELECT f.event_id AS frame, CAST(f.event_id // 5 * 5 AS BIGINT) AS source_frame, {r('''CASE WHEN s.event_type = 'purchase' THEN s.value END''', 4, 'confidence')} FROM events f LEFT JOIN events s ON s.event_id = f.event_id // 5 * 5")


def cooled(src: str, key: str, wait: int) -> str:
    return f"""kept AS (SELECT {key}, min(us) AS us FROM {src} GROUP BY 1 UNION ALL SELECT k.{key}, (SELECT min(e.us) FROM {src} e WHERE e.{key} = k.{key} AND e.us >= k.us + {wait}) AS us FROM kept k
   WHERE EXISTS (SELECT 1 FROM {src} e WHERE e.{key} = k.{key} AND e.us >= k.us + {wait}))"""


oracle("throttle", f"{EVENTS}, {cooled('ev', 'user_id', 21600000000)}", "SELECT min(event_id) AS event_id, user_id FROM kept JOIN ev USING (user_id, us) GROUP BY user_id, us")
oracle("alerts", f"{DETECTIONS}, once AS (SELECT * FROM det WHERE person QUALIFY row_number() OVER (PARTITION BY mission_id, frame ORDER BY us, event_id) = 1), {cooled('once', 'mission_id', 21600000000)}",
       "SELECT min(event_id) AS event_id, mission_id FROM kept JOIN once USING (mission_id, us) GROUP BY mission_id, us")
oracle("smoothed_rate", f"""{EVENTS}, st AS (SELECT *, 1e6 / (us - lag(us) OVER w) AS rate, us - lag(us) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 nn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM st WHERE gap > 0),
 sm AS (SELECT user_id, i, event_id, rate, rate AS fps FROM nn WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, n.rate, 0.9e0 * s.fps + 0.1e0 * n.rate FROM sm s JOIN nn n ON n.user_id = s.user_id AND n.i = s.i + 1)""",
       f"SELECT event_id, user_id, {r('rate', 9)}, {r('fps', 9)} FROM sm")
oracle("recent_log", EVENTS, "SELECT event_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) <= 200")
oracle("time_sorted", EVENTS, "SELECT event_id, us AS ts FROM ev ORDER BY us, event_id")

# --- raster
oracle("slope_aspect", TERRAIN, f"SELECT {KEYS}, {r('elevation', 3)}, {r('slope', 8)}, {r('aspect_e', 6)}, {r('aspect_n', 6)} FROM terrain")


def focal(src: str, side: str, mid: str) -> str:
    """Weighted 3 x 3 sum as two passes of windows; the border repeats."""
    def line(value: str, fixed: str, moving: str) -> str:
        w = f'OVER (PARTITION BY mission_id, {fixed} ORDER BY {moving})'
        return f"{mid} * {value} + {side} * (coalesce(lag({value}) {w}, {value}) + coalesce(lead({value}) {w}, {value}))"
    across, down = line("elevation", '"row"', "col"), line("across", "col", '"row"')
    return f"""(SELECT mission_id, "row", col, slope, elevation AS elevation0, {down} AS elevation FROM (SELECT *, {across} AS across FROM {src}))"""


oracle("smooth", f"{RELIEF}, r0 AS (SELECT *, 0 AS slope FROM relief), s1 AS (SELECT * FROM {focal('r0', '0.25e0', '0.5e0')})", f"SELECT {KEYS}, {r('elevation', 6)} FROM {focal('s1', '0.25e0', '0.5e0')}")
CLASSES = f"""{TERRAIN}, cls0 AS (SELECT *, elevation0 - (elevation - elevation0) / 8 AS tpi FROM {focal('terrain', '1', '1')}),
 cls AS (SELECT *, degrees(slope) >= 30 AS is_steep, degrees(slope) >= 45 AS is_cliff, tpi <= -5 AS is_valley, tpi >= 5 AS is_ridge FROM cls0),
 weighed AS (SELECT *, (CASE WHEN is_steep THEN 0.7e0 ELSE 1 END) * (CASE WHEN is_cliff THEN 0.2e0 ELSE 1 END) * (CASE WHEN is_valley THEN 1.15e0 ELSE 1 END) * (CASE WHEN is_ridge THEN 0.9e0 ELSE 1 END) AS weight FROM cls)"""
oracle("terrain_classes", CLASSES, f"SELECT {KEYS}, {', '.join(f'CAST({f} AS BIGINT) AS {f}' for f in ('is_steep', 'is_cliff', 'is_valley', 'is_ridge'))}, {r('tpi', 6)}, {r('weight', 6)} FROM weighed")
oracle("land_mask", RELIEF, f"SELECT {KEYS}, CAST(mission_id % 9 = 0 OR elevation > 1 AS BIGINT) AS is_land, {r('CASE WHEN mission_id % 9 = 0 THEN 0 ELSE elevation END', 3, 'elevation')} FROM relief")


def sampled(targets: str, field: str, top: int, value: str, extra: str = "", keep: str = 'mission_id, "row", col', clamp: bool = False) -> str:
    """Bilinear by four lookups per target with row_f / col_f."""
    lim = lambda x: f"greatest(0, least({top}, floor({x})))"
    v = lambda rr, cc: f"(SELECT {value} FROM {field} f WHERE f.mission_id = t.mission_id AND f.\"row\" = {rr} AND f.col = {cc})"
    return f"""(SELECT * EXCLUDE (v00, v01, v10, v11), CASE WHEN inb THEN v00 * (1 - dr) * (1 - dc) + v01 * (1 - dr) * dc + v10 * dr * (1 - dc) + v11 * dr * dc ELSE 0 END AS v FROM
  (SELECT t.*, a.{value} AS v00, b.{value} AS v01, c.{value} AS v10, d.{value} AS v11 FROM (SELECT *, row_f - r0 AS dr, col_f - c0 AS dc, least(r0 + 1, {top}) AS r1, least(c0 + 1, {top}) AS c1 FROM
    (SELECT *, {lim('row_f')} AS r0, {lim('col_f')} AS c0, {'true' if clamp else f'floor(row_f) BETWEEN 0 AND {top} AND floor(col_f) BETWEEN 0 AND {top}'} AS inb FROM {targets})) t
   JOIN {field} a ON a.mission_id = t.mission_id AND a."row" = r0 AND a.col = c0 JOIN {field} b ON b.mission_id = t.mission_id AND b."row" = r0 AND b.col = c1
   JOIN {field} c ON c.mission_id = t.mission_id AND c."row" = r1 AND c.col = c0 JOIN {field} d ON d.mission_id = t.mission_id AND d."row" = r1 AND d.col = c1))"""


oracle("upsample", f"""{RELIEF}, coarse AS (SELECT mission_id, "row" // 4 AS "row", col // 4 AS col, elevation FROM relief WHERE "row" % 4 = 0 AND col % 4 = 0), tg AS (SELECT mission_id, "row", col, "row" * (7 / 31e0) AS row_f, col * (7 / 31e0) AS col_f FROM cells)""",
       f"SELECT {KEYS}, {r('v', 6, 'elevation')} FROM {sampled('tg', 'coarse', 7, 'elevation')}")
oracle("resample_offset_grid", f"""{RELIEF}, mv0 AS (SELECT * FROM {utm('(SELECT mission_id, lkp_lat + 0.003e0 AS la, lkp_lon, 32636 AS epsg, origin_e, origin_n FROM pins)', 'la', 'lkp_lon', 'me', 'mn')}),
 mv AS (SELECT m.*, a.i AS "row", b.i AS col, me - 825e0 + (b.i + 0.5e0) * 50e0 AS e, mn + 825e0 - (a.i + 0.5e0) * 50e0 AS n FROM mv0 m, axis a, axis b),
 tg AS (SELECT mission_id, "row", col, (origin_n + 825e0 - n) / 50e0 AS row_f, (e - (origin_e - 825e0)) / 50e0 AS col_f FROM mv)""", f"SELECT {KEYS}, {r('v', 3, 'elevation')} FROM {sampled('tg', 'relief', 31, 'elevation')}")
oracle("display_samples", f"""{FORMULA}, ax2 AS (SELECT CAST(range AS INT) AS i FROM range(64)), tg AS (SELECT mission_id, a.i AS out_row, b.i AS out_col, (a.i + 0.5e0) / 2 - 0.5 AS row_f, (b.i + 0.5e0) / 2 - 0.5 AS col_f FROM pins, ax2 a, ax2 b)""",
       f"SELECT mission_id, CAST(out_row AS BIGINT) AS out_row, CAST(out_col AS BIGINT) AS out_col, {r('v', 9, 'p')} FROM {sampled('tg', 'surf', 31, 'p', clamp=True)}")
_legs = "(VALUES (-0.006e0, 0e0, 0.006e0, 0e0), (-0.002e0, -0.005e0, 0e0, 0.001e0), (0e0, 0.001e0, 0.004e0, 0.005e0)) AS g(ax, ay, qx, qy)"
oracle("road_fields", f"""{CELLS}, lg0 AS (SELECT p.*, lkp_lat + ay AS alat, lkp_lon + ax AS alon, lkp_lat + qy AS blat, lkp_lon + qx AS blon FROM pins p, {_legs}),
 lg AS (SELECT *, be - ae AS de, bn - an AS dn, sqrt((be - ae) * (be - ae) + (bn - an) * (bn - an)) AS len FROM {utm(utm('lg0', 'alat', 'alon', 'ae', 'an'), 'blat', 'blon', 'be', 'bn')}),
 smp AS (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, greatest(1, CAST(floor(len / 25e0) AS BIGINT)) AS n FROM lg)),
 hit AS (SELECT mission_id, CAST(floor((origin_n + 800e0 - (an + (k / n) * dn)) / 50e0) AS INT) AS "row", CAST(floor((ae + (k / n) * de - (origin_e - 800e0)) / 50e0) AS INT) AS col, avg(de / len) AS te, avg(dn / len) AS tn FROM smp GROUP BY 1, 2, 3),
 road AS (SELECT * FROM hit WHERE "row" BETWEEN 0 AND 31 AND col BETWEEN 0 AND 31)""",
       f"""SELECT mission_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, {r('sqrt(d2) * 50e0', 4, 'road_dist_m')}, {r('exp(-sqrt(d2) * 50e0 / 20e0)', 8, 'road_proximity')}, {r('te', 6, 'road_tangent_e')}, {r('tn', 6, 'road_tangent_n')} FROM
  (SELECT c.mission_id, c."row", c.col, (h."row" - c."row") * (h."row" - c."row") + (h.col - c.col) * (h.col - c.col) AS d2, h.te, h.tn FROM cells c JOIN road h USING (mission_id)
   QUALIFY row_number() OVER (PARTITION BY c.mission_id, c."row", c.col ORDER BY d2, h.col, h."row") = 1)""")
oracle("road_factor", PLACED, f"SELECT event_id, {r(f'1 + 1.05e0 * {PROX}', 8, 'factor')} FROM onto")
oracle("node_fields", f"""{TERRAIN}, nf AS (SELECT *, {PROX} AS prox, CASE WHEN mission_id % 4 < 2 THEN 1e0 ELSE (mission_id % 7 + 0.5e0) / 3.6e0 * sin(radians(mission_id * 37 % 360)) END AS u,
  CASE WHEN mission_id % 4 < 2 THEN 0.5e0 ELSE (mission_id % 7 + 0.5e0) / 3.6e0 * cos(radians(mission_id * 37 % 360)) END AS v FROM terrain)""",
       f"""SELECT {KEYS}, {r('prox', 8, 'road_proximity')}, {r('CASE WHEN prox >= exp(-4e0) THEN 1 ELSE 0 END', 1, 'is_road')}, {r('degrees(slope)', 6, 'slope')}, {r('CASE WHEN is_land THEN 1 ELSE 0 END', 1, 'is_land')},
  {r('CASE WHEN weather THEN 4 ELSE 0 END', 3, 'wind_u')}, {r('CASE WHEN weather THEN 2.5 ELSE 0 END', 3, 'wind_v')}, {r('CASE WHEN is_land THEN 0 ELSE u END', 8, 'current_u')}, {r('CASE WHEN is_land THEN 0 ELSE v END', 8, 'current_v')},
  {r('CASE WHEN is_land THEN 0 ELSE sqrt(u * u + v * v) END', 8, 'current_speed')}, {r('CASE WHEN is_land THEN 0 ELSE (degrees(atan2(u, v)) + 360) % 360 END', 6, 'current_heading')} FROM nf""")
oracle("marine_current", "m AS (SELECT c_custkey, c_custkey % 5 > 2 AS ok, (c_custkey % 9 + 0.25e0) / 3.6e0 AS s, CAST(c_custkey % 360 AS DOUBLE) AS d FROM customer)",
       f"SELECT c_custkey, CASE WHEN ok THEN 'open_meteo' ELSE 'fallback' END AS source, {r('CASE WHEN ok THEN s * sin(radians(d)) ELSE 1 END', 8, 'u')}, {r('CASE WHEN ok THEN s * cos(radians(d)) ELSE 0.5 END', 8, 'v')}, {r('CASE WHEN ok THEN s ELSE sqrt(1.25e0) END', 8, 'speed')}, {r('CASE WHEN ok THEN d ELSE degrees(atan2(1e0, 0.5e0)) END', 6, 'direction')} FROM m")
_edge = "least(1e0, least(\"row\", 31 - \"row\", col, 31 - col) / 5e0)"
_rad = "greatest(0e0, least(1e0, (sqrt(power((\"row\" - 15.5e0) / 15.5e0, 2) + power((col - 15.5e0) / 15.5e0, 2)) - 0.6e0) / 0.4e0))"
for _n, _t, _f in (("edge_fade", _edge, "t * t * (3 - 2 * t)"), ("radial_fade", _rad, "1 - t * t * (3 - 2 * t)")):
    oracle(_n, FORMULA, f"SELECT {KEYS}, {r('q / sum(q) OVER (PARTITION BY mission_id)', 9, 'p')} FROM (SELECT *, p * ({_f}) AS q FROM (SELECT *, {_t} AS t FROM surf))")

# --- transport
EDGES = f"""{COSTED}, edges AS (SELECT a.mission_id, a."row", a.col, a."row" + dr AS n_row, a.col + dc AS n_col, idx, sqrt(dr * dr + dc * dc) AS l2, b.cost IS NOT NULL AS inside,
   (0.28e0 + 0.72e0 / greatest(coalesce(b.cost, 0.5e0), 0.5e0)) / sqrt(dr * dr + dc * dc) * CASE WHEN NOT a.on_road AND coalesce(b.on_road, false) THEN 1.35e0 ELSE 1 END AS weight
   FROM (SELECT * FROM costed, {EIGHT}) a LEFT JOIN costed b ON b.mission_id = a.mission_id AND b."row" = a."row" + a.dr AND b.col = a.col + a.dc)"""
oracle("cost_map", COSTED, f"SELECT {KEYS}, {r('cost', 3)} FROM costed")
oracle("transition_edges", EDGES, f"SELECT {KEYS}, CAST(n_row AS BIGINT) AS n_row, CAST(n_col AS BIGINT) AS n_col, CAST(idx AS BIGINT) AS idx, {r('weight', 8)} FROM edges WHERE inside")
oracle("neighbour_share", EDGES, f"SELECT {KEYS}, CAST(idx AS BIGINT) AS idx, {r('weight / sum(weight) OVER (PARTITION BY mission_id, \"row\", col)', 8, 'weight')} FROM edges WHERE inside")
NINE_IDX = "(VALUES (-1,-1,0),(-1,0,1),(-1,1,2),(0,-1,3),(0,0,4),(0,1,5),(1,-1,6),(1,0,7),(1,1,8)) AS o(dr, dc, idx)"
_in9 = '"row" + dr BETWEEN 0 AND 31 AND col + dc BETWEEN 0 AND 31'
oracle("road_weights", EDGES, f"SELECT {KEYS}, CAST(n_row AS BIGINT) AS n_row, CAST(n_col AS BIGINT) AS n_col, CAST(idx AS BIGINT) AS idx, {r('0.88e0 * weight', 8, 'weight')} FROM edges WHERE inside")
oracle("wind_weights", f"{CELLS}, w AS (SELECT *, 4e0 AS u, 2.5e0 - mission_id % 6 AS v FROM cells), a AS (SELECT *, (u * dc - v * dr) / sqrt(u * u + v * v) AS al FROM w, {NINE_IDX})",
       f"SELECT {KEYS}, CAST(idx AS BIGINT) AS idx, {r('CASE WHEN idx <> 4 AND al > 0 THEN sqrt(10 / 60e0) * least(sqrt(u * u + v * v) / 5, 1.5e0) * al ELSE 0 END', 8, 'weight')} FROM a WHERE {_in9}")
oracle("current_weights", f"{RELIEF}, a AS (SELECT *, (0.4e0 * dc + 0.1e0 * dr) / (sqrt(0.17e0) * sqrt(dr * dr + dc * dc)) AS al FROM relief, {NINE_IDX})",
       f"SELECT {KEYS}, CAST(idx AS BIGINT) AS idx, {r('CASE WHEN elevation <= 1 AND idx <> 4 AND al > 0 THEN 1.2e0 * 2.5e0 * least(sqrt(0.17e0) * 10 / 50, 1.5e0) * al ELSE 0 END', 8, 'weight')} FROM a WHERE {_in9}")


def pushes(first: str, share: str, stay: str, steps: int) -> str:
    """Chained scatter steps: each cell keeps ``stay`` and sends ``share`` along its edges."""
    out = [f's0 AS MATERIALIZED ({first})']
    for k in range(1, steps + 1):
        out.append(f"""s{k} AS MATERIALIZED (SELECT mission_id, "row", col, sum(p) AS p FROM (SELECT s.mission_id, s."row", s.col, s.p * y.share AS p FROM s{k - 1} s JOIN {stay} y USING (mission_id, "row", col)
      UNION ALL SELECT s.mission_id, e.n_row, e.n_col, s.p * e.share FROM s{k - 1} s JOIN {share} e ON e.mission_id = s.mission_id AND e."row" = s."row" AND e.col = s.col WHERE s.p <> 0) GROUP BY 1, 2, 3)""")
    return ", ".join(out)


SHARES = f"""{EDGES}, dsum AS (SELECT mission_id, "row", col, 0.11e0 + sum(weight) AS w FROM edges GROUP BY 1, 2, 3), dstay AS (SELECT mission_id, "row", col, 0.11e0 / w AS share FROM dsum),
 dshare AS MATERIALIZED (SELECT e.*, weight / w AS share FROM edges e JOIN dsum USING (mission_id, "row", col) WHERE inside)"""
oracle("diffuse", f"""{SHARES}, {pushes('SELECT mission_id, "row", col, p + CASE WHEN "row" = 1 AND col = 1 THEN 0.5e0 ELSE 0 END AS p FROM cells', 'dshare', 'dstay', 3)}""", f"SELECT {KEYS}, {r('p', 9)} FROM s3")
oracle("drift", f"""{TERRAIN}, al AS (SELECT t.*, "row" + dr AS n_row, col + dc AS n_col, 1 + 2.5e0 * greatest((0.4e0 * dc + 0.3e0 * dr) / (0.5e0 * sqrt(dr * dr + dc * dc)), 0) AS w FROM terrain t, {EIGHT} WHERE NOT is_land),
 asum AS (SELECT mission_id, "row", col, 0.15e0 + sum(w) AS tot FROM al GROUP BY 1, 2, 3), ashare AS MATERIALIZED (SELECT a.mission_id, a."row", a.col, n_row, n_col, w / tot AS share FROM al a JOIN asum USING (mission_id, "row", col) WHERE n_row BETWEEN 0 AND 31 AND n_col BETWEEN 0 AND 31),
 astay AS (SELECT t.mission_id, t."row", t.col, CASE WHEN t.is_land THEN 1e0 ELSE 0.15e0 / tot END AS share FROM terrain t LEFT JOIN asum USING (mission_id, "row", col)),
 {pushes('SELECT mission_id, "row", col, CASE WHEN "row" < 4 AND col < 4 THEN 1e0 ELSE p END AS p FROM terrain', 'ashare', 'astay', 2)}, m0 AS (SELECT mission_id, sum(p) AS m FROM s0 GROUP BY 1), m2 AS (SELECT mission_id, sum(p) AS m FROM s2 GROUP BY 1)""",
       f"SELECT s2.mission_id, CAST(\"row\" AS BIGINT) AS \"row\", CAST(col AS BIGINT) AS col, {r('p * (m0.m / m2.m)', 9, 'p')} FROM s2 JOIN m0 USING (mission_id) JOIN m2 USING (mission_id)")


def walk(src: str, hours: str) -> str:
    return f"""hops AS MATERIALIZED (SELECT a.mission_id, a."row", a.col, b."row" AS n_row, b.col AS n_col, run / 1000 / greatest(4.2e0 / exp(-3.5e0 * 0.05e0) * exp(-3.5e0 * abs((b.elevation - a.elevation) / run + 0.05e0)), 1e-6) AS h
   FROM (SELECT *, sqrt(dr * dr + dc * dc) * res_m AS run FROM {src}, {EIGHT}) a JOIN {src} b ON b.mission_id = a.mission_id AND b."row" = a."row" + a.dr AND b.col = a.col + a.dc),
 walk(mission_id, "row", col, t) USING KEY (mission_id, "row", col) AS (SELECT mission_id, "row", col, 0e0 AS t FROM {src} WHERE is_pin UNION SELECT x.mission_id, x.n_row, x.n_col, x.t FROM
   (SELECT h.mission_id, h.n_row, h.n_col, min(w.t + h.h) AS t FROM walk w JOIN hops h ON h.mission_id = w.mission_id AND h."row" = w."row" AND h.col = w.col WHERE w.t + h.h <= {hours} GROUP BY 1, 2, 3) x
   LEFT JOIN recurring.walk k ON k.mission_id = x.mission_id AND k."row" = x.n_row AND k.col = x.n_col WHERE k.t IS NULL OR x.t < k.t)"""


oracle("travel_time", f"{RELIEF}, {walk('relief', '0.35e0')}", f"SELECT c.mission_id, CAST(c.\"row\" AS BIGINT) AS \"row\", CAST(c.col AS BIGINT) AS col, {r('w.t', 8, 'travel_h')} FROM relief c LEFT JOIN walk w USING (mission_id, \"row\", col)")
oracle("reachability", f"""{CLASSES}, {walk('relief', '0.35e0')}, rr AS (SELECT c.mission_id, c."row", c.col, coalesce((0.35e0 - t) / 0.35e0, 0) AS score, coalesce((0.35e0 - t) / 0.35e0 * weight, 0) AS a, coalesce(exp(-t / (0.35e0 / 3)), 0) AS b FROM weighed c LEFT JOIN walk USING (mission_id, "row", col)),
 nn AS (SELECT *, a / sum(a) OVER (PARTITION BY mission_id) AS reach, b / sum(b) OVER (PARTITION BY mission_id) AS reach_exp FROM rr), bl AS (SELECT *, (1 / 1024e0) * (0.2e0 + 0.8e0 * greatest(reach, 0.12e0 * max(reach) OVER (PARTITION BY mission_id), 1e-12)) AS q FROM nn)""",
       f"SELECT {KEYS}, {r('reach', 9)}, {r('score', 8, 'reach_score')}, {r('reach_exp', 9)}, {r('q / sum(q) OVER (PARTITION BY mission_id)', 9, 'p')} FROM bl")


# tiles give what whole grids give
ORACLES |= {f"{name}_tiles": ORACLES[name] for name in ("diffuse", "drift", "travel_time")}


def stack(tick: int) -> str:
    """Topography and personality of one tick as CTE ``pe{tick}``; the walk must be there."""
    h = (tick + 1) * 1e0
    a, b = f"tp{tick}", f"pe{tick}"
    target = f"CASE WHEN t IS NULL OR t > {h}e0 THEN 0 ELSE ({h}e0 - t) / {h}e0 END"
    return f"""{a} AS (SELECT c.*, CASE WHEN NOT topography THEN p WHEN NOT is_land THEN 0 ELSE 0.45e0 * p + 0.55e0 * ({target}) * CASE WHEN degrees(slope) >= 30 THEN 0.7e0 ELSE 1 END END AS q FROM costed c LEFT JOIN walk USING (mission_id, "row", col)),
 {b} AS MATERIALIZED (SELECT * EXCLUDE (q), CASE WHEN personality AND NOT is_pin THEN q * power(greatest(0.35e0, least(1.2e0, 1.2e0 - (age - 10) / 100e0)) * (0.85e0 + 0.1e0 * (fitness - 1)) * CASE WHEN injured THEN 0.45e0 ELSE 1 END,
    1 + least(1, sqrt(("row" - 16) * ("row" - 16) + (col - 16) * (col - 16)) / 16e0)) ELSE q END AS q FROM {a})"""


_pe_mask = "CASE WHEN (wet AND is_land) OR (NOT wet AND NOT is_land) THEN 0 ELSE q END"
def stacked(tick: int, diffusion: int, advection: int) -> str:
    """Masked surface ``fin`` of one tick through all layers."""
    waves = pushes('SELECT mission_id, "row", col, p FROM terrain WHERE wet', 'ashare', 'astay', advection)
    for k in range(advection + 1):
        waves = waves.replace(f"s{k} AS", f"z{k} AS").replace(f"FROM s{k} s", f"FROM z{k} s")
    return f"""{SHARES}, {walk('relief', f'{tick + 1}e0')}, {stack(tick)}, {pushes(f'SELECT mission_id, "row", col, q AS p FROM pe{tick} WHERE roads', 'dshare', 'dstay', diffusion)},
 rd AS (SELECT b.*, CASE WHEN NOT b.roads THEN q ELSE 0.12e0 * q + 0.88e0 * CASE WHEN is_pin THEN greatest(s.p * bo, q * bo) ELSE s.p * bo END END AS g FROM (SELECT *, 1 + 0.88e0 * 1.05e0 * {PROX} AS bo FROM pe{tick}) b LEFT JOIN s{diffusion} s USING (mission_id, "row", col)),
 al AS (SELECT t.*, "row" + dr AS n_row, col + dc AS n_col, 1 + sqrt(60e0) * 2.5e0 * greatest((0.4e0 * dc) / (0.4e0 * sqrt(dr * dr + dc * dc)), 0) AS w FROM terrain t, {EIGHT} WHERE wet AND NOT is_land),
 asum AS (SELECT mission_id, "row", col, 0.15e0 + sum(w) AS tot FROM al GROUP BY 1, 2, 3), ashare AS (SELECT a.mission_id, a."row", a.col, n_row, n_col, w / tot AS share FROM al a JOIN asum USING (mission_id, "row", col) WHERE n_row BETWEEN 0 AND 31 AND n_col BETWEEN 0 AND 31),
 astay AS (SELECT t.mission_id, t."row", t.col, CASE WHEN t.is_land THEN 1e0 ELSE 0.15e0 / tot END AS share FROM terrain t LEFT JOIN asum USING (mission_id, "row", col) WHERE t.wet),
 {waves}, zm AS (SELECT mission_id, sum(p) AS m FROM z{advection} GROUP BY 1),
 fin AS (SELECT r.* EXCLUDE (p), CASE WHEN wet THEN CASE WHEN is_land THEN 0 ELSE z.p / zm.m END WHEN NOT is_land THEN 0 ELSE g END AS p FROM rd r LEFT JOIN z{advection} z USING (mission_id, "row", col) LEFT JOIN zm USING (mission_id))"""


oracle("layer_stack", stacked(1, 6, 2), f"SELECT {KEYS}, {r('p', 9)} FROM fin")


def mpp_of(src: str) -> str:
    return f"""mi AS (SELECT *, "row" BETWEEN 1 AND 30 AND col BETWEEN 1 AND 30 AS inn FROM {src}), mh AS (SELECT mission_id, count(*) FILTER (inn AND p > 1e-12) > 0 AS has FROM mi GROUP BY 1),
 mv AS (SELECT mi.*, CASE WHEN inn OR NOT has THEN p ELSE 0 END AS v FROM mi JOIN mh USING (mission_id)), mc AS (SELECT mission_id, quantile_cont(CASE WHEN v > 1e-12 THEN v END, 0.95) AS cut FROM mv GROUP BY 1),
 mm AS (SELECT mv.* FROM mv JOIN mc USING (mission_id) WHERE v >= cut)"""


oracle("mpp_formula", f"{FORMULA}, {mpp_of('surf')}", f"SELECT mission_id, count(*) AS n_cells, {r('sum(lat * v) / sum(v)', 8, 'lat')}, {r('sum(lon * v) / sum(v)', 8, 'lon')} FROM {latlon('mm')} GROUP BY 1")

oracle("mpp", f"{stacked(3, 18, 6)}, {mpp_of('fin')}", f"SELECT mission_id, count(*) AS n_cells, {r('sum(lat * v) / sum(v)', 8, 'lat')}, {r('sum(lon * v) / sum(v)', 8, 'lon')} FROM {latlon('mm')} GROUP BY 1")

# --- evidence
oracle("tick_join", PLACED, """SELECT mission_id, CAST(floor((us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) + 1 AS BIGINT) AS tick, CAST(count(*) FILTER (person) AS BIGINT) AS finds, CAST(count(*) FILTER (NOT person) AS BIGINT) AS sweeps FROM det GROUP BY 1, 2""")


def swept(radius: float) -> str:
    return f"""swp AS MATERIALIZED (SELECT DISTINCT t.mission_id, t.tick, c."row", c.col FROM timed t JOIN (SELECT a.i AS "row", b.i AS col FROM (SELECT CAST(range AS INT) AS i FROM range(32)) a, (SELECT CAST(range AS INT) AS i FROM range(32)) b) c
   ON abs(c."row" - t."row") <= 3 AND abs(c.col - t.col) <= 3 WHERE NOT t.person AND ((c."row" = t."row" AND c.col = t.col)
   OR power(t.origin_e - 825e0 + (c.col + 0.5e0) * 50 - t.point_e, 2) + power(t.origin_n + 825e0 - (c."row" + 0.5e0) * 50 - t.point_n, 2) <= {radius * radius}e0))"""


oracle("swept_cells", f"{PLACED}, {swept(60.0)}", f"SELECT mission_id, tick, CAST(\"row\" AS BIGINT) AS \"row\", CAST(col AS BIGINT) AS col FROM swp")
CLEAN = f"{PLACED}, {swept(10.0)}, cln AS (SELECT mission_id, \"row\", col, max(tick) AS last_sweep, power(0.9e0, 300 - max(tick)) AS clean FROM swp WHERE tick <= 300 GROUP BY 1, 2, 3)"
oracle("clean_scores", CLEAN, f"SELECT {KEYS}, last_sweep, {r('clean', 9)} FROM cln")
oracle("boost_factors", PLACED, f"SELECT mission_id, tick, CAST(\"row\" AS BIGINT) AS \"row\", CAST(col AS BIGINT) AS col, count(*) AS n_events, {r('product(1 + 0.6e0 * confidence)', 8, 'boost')} FROM timed WHERE person GROUP BY 1, 2, 3, 4")
_tail = PLACED[len(PINS) + 2:]
oracle("suppress_boost", f"""{FORMULA}, {CLEAN[len(PINS) + 2:]}, bst AS (SELECT mission_id, "row", col, product(1 + 0.6e0 * confidence) AS b FROM timed WHERE person GROUP BY 1, 2, 3),
 s1 AS (SELECT f.mission_id, f."row", f.col, f.p * (1 - 0.8e0 * coalesce(clean, 0)) AS q FROM surf f LEFT JOIN cln USING (mission_id, "row", col)), s2 AS (SELECT s1.*, q / sum(q) OVER (PARTITION BY s1.mission_id) * coalesce(b, 1) AS v FROM s1 LEFT JOIN bst USING (mission_id, "row", col))""",
       f"SELECT {KEYS}, {r('v / sum(v) OVER (PARTITION BY mission_id)', 9, 'p')} FROM s2")
_ring = [(-0.0041, -0.0032), (0.0049, -0.0017), (0.0036, 0.0043), (-0.0022, 0.0028)]
_hole = [(-0.0011, -0.0009), (0.0013, -0.0009), (0.0013, 0.0011), (-0.0011, 0.0011)]
_sides = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for ring in (_ring, _hole) for a, b in zip(ring, ring[1:] + ring[:1]))
def _held(name: str, east: str) -> str:
    """Cells inside the search polygon moved east by so many degrees."""
    return f""" {name} AS (SELECT mission_id, "row", col FROM (SELECT c.mission_id, c."row", c.col, count(*) FILTER ((lkp_lat + ay > lat) <> (lkp_lat + qy > lat) AND lon < ((lkp_lon + qx + far) - (lkp_lon + ax + far)) * (lat - (lkp_lat + ay)) / ((lkp_lat + qy) - (lkp_lat + ay)) + (lkp_lon + ax + far)) AS n
   FROM (SELECT *, {east} AS far FROM located) c, sides GROUP BY 1, 2, 3) WHERE n % 2 = 1)"""


_far = "CASE WHEN mission_id % 10 = 0 THEN 5e0 ELSE 0 END"
HITS = f"sides AS (SELECT * FROM (VALUES {_sides}) AS g(ax, ay, qx, qy)), located AS (SELECT * FROM {latlon('surf')}), {_held('hits', _far)}"


def _search(out: str, given: str, hits: str, pod: str) -> str:
    """One search: lower, floor, renormalise missions it touches."""
    return f""", {out}_q AS (SELECT s.*, h.mission_id IS NOT NULL AS hit, CASE WHEN h.mission_id IS NULL THEN s.p ELSE greatest(s.p * (1 - least(0.99e0, {pod})), 1e-8) END AS q
   FROM {given} s LEFT JOIN {hits} h USING (mission_id, "row", col)),
 {out} AS (SELECT * EXCLUDE (hit, q, p, searched), searched OR hit AS searched, CASE WHEN bool_or(hit) OVER (PARTITION BY mission_id) THEN q / sum(q) OVER (PARTITION BY mission_id) ELSE p END AS p FROM {out}_q)"""


NEG = f"""{FORMULA}, {HITS}, {_held('again', "CASE WHEN mission_id % 3 = 0 THEN 0.001e0 ELSE 9e0 END")},
 ng AS (SELECT mission_id, "row", col, p, p AS old, FALSE AS searched FROM surf){_search('n1', 'ng', 'hits', "0.5e0 + s.mission_id % 7 / 10e0")}{_search('nw', 'n1', 'again', "0.3e0")}"""
oracle("cells_in_polygon", f"{FORMULA}, {HITS}", f"SELECT {KEYS} FROM hits")
oracle("negative_search", NEG, f"SELECT {KEYS}, CAST(searched AS BIGINT) AS searched, {r('p', 9)} FROM nw")
oracle("heatmap_delta", NEG, f"SELECT {KEYS}, {r('p', 9)} FROM nw WHERE abs(p - old) > 1e-5")
oracle("delta_merge", f"{FORMULA}, {_tail}, lst AS (SELECT mission_id, \"row\", col, arg_max(confidence, event_id) AS c FROM onto GROUP BY 1, 2, 3)", f"SELECT s.mission_id, CAST(s.\"row\" AS BIGINT) AS \"row\", CAST(s.col AS BIGINT) AS col, {r('coalesce(c, s.p)', 9, 'p')} FROM surf s LEFT JOIN lst USING (mission_id, \"row\", col)")
oracle("footprint_union", f"{PLACED}, u AS (SELECT DISTINCT mission_id, \"row\", col FROM onto)", "SELECT mission_id, count(*) AS seen_cells, CAST(1024 - count(*) AS BIGINT) AS open_cells FROM u GROUP BY 1 HAVING count(*) < 1024")
_masked = ", ".join(f'mk{t} AS MATERIALIZED (WITH RECURSIVE {stacked(t, 6 * t, 2 * max(1, t))} SELECT mission_id, "row", col, wet, p AS m FROM fin)' for t in range(4))
ONLY = f"{PINS}, {_masked}"
oracle("history_blend", ONLY, f"""SELECT a.mission_id, CAST(a."row" AS BIGINT) AS "row", CAST(a.col AS BIGINT) AS col, {r('CASE WHEN a.wet THEN d.m ELSE 0.6e0 * (0.6e0 * (0.6e0 * a.m + 0.4e0 * b.m) + 0.4e0 * c.m) + 0.4e0 * d.m END', 9, 'p')}
  FROM mk0 a JOIN mk1 b USING (mission_id, "row", col) JOIN mk2 c USING (mission_id, "row", col) JOIN mk3 d USING (mission_id, "row", col)""")
_fold = ""
for _t in (1, 2, 3):
    _prev = "mk0" if _t == 1 else f"f{_t - 1}"
    _pm = "m" if _t == 1 else "p"
    _fold += f""", g{_t} AS (SELECT k.mission_id, k."row", k.col, CASE WHEN k.wet THEN k.m ELSE 0.6e0 * o.{_pm} + 0.4e0 * k.m END AS v, coalesce((SELECT power(0.9e0, {_t} - max(tick)) FROM swp w WHERE w.tick <= {_t} AND w.mission_id = k.mission_id AND w."row" = k."row" AND w.col = k.col), 0) AS cl FROM mk{_t} k JOIN {_prev} o USING (mission_id, "row", col)),
 h{_t} AS (SELECT *, CASE WHEN max(cl) OVER w > 0 AND sum(v * (1 - 0.8e0 * cl)) OVER w > 0 THEN v * (1 - 0.8e0 * cl) / sum(v * (1 - 0.8e0 * cl)) OVER w ELSE v END AS q FROM g{_t} WINDOW w AS (PARTITION BY mission_id)),
 b{_t} AS (SELECT h.mission_id, h."row", h.col, q, b, q * coalesce(b, 1) AS qb FROM h{_t} h LEFT JOIN (SELECT mission_id, "row", col, product(1 + 0.6e0 * confidence) AS b FROM timed WHERE person AND tick = {_t} GROUP BY 1, 2, 3) USING (mission_id, "row", col)),
 f{_t} AS MATERIALIZED (SELECT mission_id, "row", col, CASE WHEN count(b) OVER (PARTITION BY mission_id) > 0 AND sum(qb) OVER (PARTITION BY mission_id) > 0 THEN qb / sum(qb) OVER (PARTITION BY mission_id) ELSE qb END AS p FROM b{_t})"""
oracle("tick_fold", f"{ONLY}, {_tail}, {swept(10.0)}{_fold}".replace("3.6e9", "8.64e11"), f"SELECT {KEYS}, {r('p', 9)} FROM f3")

# --- ranking, statistics, exports
RANKED = f"{FORMULA}, rk AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY p DESC, \"row\" DESC, col DESC) AS rank FROM surf WHERE p > 1e-12)"
oracle("top_cells", RANKED, f"SELECT {KEYS}, rank, {r('lat', 8)}, {r('lon', 8)}, {r('p', 9)} FROM {latlon('rk')} WHERE rank <= 50")
oracle("route_candidates", RANKED, f"SELECT {KEYS}, rank FROM rk WHERE rank <= 128")
PUBLISHED = f"""{TERRAIN}, pub AS (SELECT mission_id, CASE WHEN mission_id % 9 = 0 THEN 0 ELSE {PROX} END AS road_proximity, CASE WHEN {PROX} >= exp(-4e0) AND mission_id % 9 <> 0 THEN 1e0 ELSE 0e0 END AS is_road,
  greatest(0e0, 1 - sqrt(("row" - 16) * ("row" - 16) + (col - 16) * (col - 16)) / 10e0) AS reachability, elevation, degrees(slope) AS slope, CASE WHEN is_land THEN 1e0 ELSE 0e0 END AS is_land, CASE WHEN weather THEN 4e0 ELSE 0e0 END AS wind_u, CASE WHEN weather THEN 2.5e0 ELSE 0e0 END AS wind_v,
  CASE WHEN is_land THEN 0e0 ELSE 0.4e0 * sin(radians(90)) END AS current_u, CASE WHEN is_land THEN 0e0 ELSE 0.4e0 * cos(radians(90)) END AS current_v, CASE WHEN is_land THEN 0e0 ELSE 0.4e0 END AS current_speed, CASE WHEN is_land THEN 0e0 ELSE 90e0 END AS current_heading FROM terrain),
 lng AS (UNPIVOT pub ON {', '.join(report.FIELD_NAMES)} INTO NAME field VALUE v), fst AS (SELECT mission_id, field, min(v) AS mn, max(v) AS mx, count(*) FILTER (v > 1e-9) / count(*) AS nz FROM lng GROUP BY 1, 2)"""
oracle("field_stats", PUBLISHED, f"SELECT mission_id, field, {r('mn', 6, 'min')}, {r('mx', 6, 'max')}, {r('nz', 8, 'nonzero_frac')} FROM fst")
oracle("field_warnings", PUBLISHED, f"""SELECT mission_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w, '|') AS warnings FROM (SELECT mission_id, list_filter([CASE WHEN rm <= 1e-9 THEN '{report.WARN_ROADS}' END, CASE WHEN em <= 1e-9 AND sm <= 1e-9 THEN '{report.WARN_ELEVATION}' END, CASE WHEN ln <= 1e-9 THEN '{report.WARN_LAND}' END, CASE WHEN cm <= 1e-9 THEN '{report.WARN_REACH}' END], lambda x: x IS NOT NULL) AS w FROM
  (SELECT mission_id, max(mx) FILTER (field = 'road_proximity') AS rm, max(mx) FILTER (field = 'elevation') AS em, max(mx) FILTER (field = 'slope') AS sm, max(nz) FILTER (field = 'is_land') AS ln, max(mx) FILTER (field = 'reachability') AS cm FROM fst GROUP BY 1))""")
oracle("field_range", f"""{PUBLISHED}, ord AS (SELECT *, row_number() OVER (PARTITION BY mission_id, field ORDER BY v) AS i FROM lng), rg AS (SELECT mission_id, field, CASE WHEN field IN ('elevation', 'slope') THEN max(v) FILTER (i = 21) ELSE min(v) END AS a, CASE WHEN field IN ('elevation', 'slope') THEN max(v) FILTER (i = 1004) ELSE max(v) END AS b FROM ord GROUP BY 1, 2)""",
       f"SELECT mission_id, field, {r('''CASE WHEN field = 'reachability' THEN 0 ELSE a END''', 6, 'range_min')}, {r('''CASE WHEN field = 'reachability' THEN CASE WHEN b > 1e-9 THEN b ELSE 1 END WHEN b - a < 1e-9 THEN a + 1 ELSE b END''', 6, 'range_max')} FROM rg")
oracle("color_range", f"{FORMULA}, cr AS (SELECT mission_id, min(p) AS a, max(p) AS b, count(*) FILTER (p > 1e-8) / count(*) AS share FROM surf GROUP BY 1)",
       f"SELECT mission_id, CAST(share > 0 AND share < 0.01 AS BIGINT) AS low_mass, {r('CASE WHEN b - a <= 1e-8 THEN 0 ELSE a END', 9, 'range_min')}, {r('CASE WHEN b - a <= 1e-8 THEN 1 ELSE b END', 9, 'range_max')}, {r('greatest(b, 1e-8)', 9, 'grid_max')}, {r('a', 9, 'grid_min')}, {r('share', 6)} FROM cr")
oracle("unit_surface", f"{FORMULA}, un AS (SELECT *, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) AS unit FROM surf WINDOW w AS (PARTITION BY mission_id))", f"SELECT {KEYS}, CAST(unit >= 0.41e0 AS BIGINT) AS masked, {r('unit', 12)} FROM un")
oracle("heatmap_export", f"{FORMULA}, {META[len(PINS) + 2:]}", f"""SELECT s.mission_id, count(*) AS n, CAST(32 AS BIGINT) AS "rows", {r('max(p) FILTER ("row" = 0 AND col = 0)', 9, 'p0')}, {r('max(p) FILTER ("row" = 15 AND col = 20)', 9, 'p500')}, {r('max(p) FILTER ("row" = 31 AND col = 31)', 9, 'p1023')}, {r('any_value(north)', 8, 'north')} FROM surf s JOIN meta USING (mission_id) GROUP BY 1""")
oracle("terrain_report", TERRAIN, f"""SELECT mission_id, count(*) AS n, CAST(1 AS BIGINT) AS n_warnings, {r('max(elevation) FILTER ("row" = 31 AND col = 31)', 3, 'last_elevation')}, {r('max(degrees(slope))', 6, 'max_slope')} FROM terrain GROUP BY 1""")


def moved(lat: str, u: str, v: str, length: str, axis: str) -> str:
    base = f"({u}) * (({length}) / sqrt(({u}) * ({u}) + ({v}) * ({v})))" if axis == "lon" else f"({v}) * (({length}) / sqrt(({u}) * ({u}) + ({v}) * ({v})))"
    return f"({base} / (111320e0 * cos(radians({lat}))))" if axis == "lon" else f"({base} / 111320e0)"


ARROWS = f"""{META}, axis AS (SELECT CAST(range AS INT) AS i FROM range(32)), gr AS (SELECT m.*, a.i AS "row", b.i AS col, a.i + b.i < shore AS water, west + (b.i + 0.5e0) / 32 * (east - west) AS lo, north - (a.i + 0.5e0) / 32 * (north - south) AS la FROM meta m, axis a, axis b),
 arr AS (SELECT mission_id, "row", col, lo, la, 0.4e0 AS u, 0.4e0 * cos(radians(90)) AS v, 0.4e0 AS sp, 600 * (0.35e0 + 0.65e0 * (0.4e0 / CASE WHEN mission_id % 2 = 0 THEN sqrt(1.25e0) ELSE 0.4e0 END)) AS len, 'shaft' AS kind, CAST(NULL AS VARCHAR) AS source FROM gr WHERE water AND "row" % 2 = 0 AND col % 2 = 0
   UNION ALL SELECT mission_id, "row", col, lo, la, 1e0, 0.5e0, sqrt(1.25e0), 810e0, 'lkp', 'fallback' FROM gr WHERE "row" = 16 AND col = 16 AND mission_id % 2 = 0),
 tip AS (SELECT *, lo + {moved('la', 'u', 'v', 'len', 'lon')} AS tlo, la + {moved('la', 'u', 'v', 'len', 'lat')} AS tla, -u / sp * 0.42e0 - v / sp * 0.42e0 AS lu, -v / sp * 0.42e0 + u / sp * 0.42e0 AS lv, -u / sp * 0.42e0 + v / sp * 0.42e0 AS ru, -v / sp * 0.42e0 - u / sp * 0.42e0 AS rv FROM arr)"""
oracle("current_vectors", ARROWS,
       f"""SELECT {KEYS}, kind, source, {r('lo', 7, 'lon')}, {r('la', 7, 'lat')}, {r('sp', 6, 'speed')}, {r('len', 4, 'length_m')}, {r('tlo', 7, 'tip_lon')}, {r('tla', 7, 'tip_lat')}, {r('tlo - ' + moved('tla', 'lu', 'lv', 'len * 0.22e0', 'lon'), 7, 'left_lon')}, {r('tla - ' + moved('tla', 'lu', 'lv', 'len * 0.22e0', 'lat'), 7, 'left_lat')},
  {r('tlo - ' + moved('tla', 'ru', 'rv', 'len * 0.22e0', 'lon'), 7, 'right_lon')}, {r('tla - ' + moved('tla', 'ru', 'rv', 'len * 0.22e0', 'lat'), 7, 'right_lat')} FROM tip""")
oracle("nearest_land", f"""{PLACED}, spot AS (SELECT event_id, mission_id, shore, CAST(greatest(0, least(31, floor(row_f))) AS INT) AS r, CAST(greatest(0, least(31, floor(col_f))) AS INT) AS c FROM placed), ax AS (SELECT CAST(range AS INT) AS i FROM range(32))""",
       """SELECT event_id, CAST(x.i AS BIGINT) AS near_row, CAST(y.i AS BIGINT) AS near_col, CAST((x.i - r) * (x.i - r) + (y.i - c) * (y.i - c) AS BIGINT) AS near_d2 FROM spot, ax x, ax y WHERE r + c < shore AND x.i + y.i >= shore
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY near_d2, x.i, y.i) = 1""")
oracle("vectors_geojson", ARROWS.replace("mission_id % 2 = 0", "FALSE"), f"""SELECT mission_id, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, 'shaft' AS kind, CAST(2 AS BIGINT) AS points, {r('lo', 7, 'lon')}, {r('la', 7, 'lat')}, {r('tlo', 7, 'tip_lon')}, {r('tla', 7, 'tip_lat')} FROM tip
 UNION ALL SELECT mission_id, CAST("row" AS BIGINT), CAST(col AS BIGINT), 'head', CAST(3 AS BIGINT), {r("tlo - " + moved('tla', 'lu', 'lv', 'len * 0.22e0', 'lon'), 7, 'a')}, {r("tla - " + moved('tla', 'lu', 'lv', 'len * 0.22e0', 'lat'), 7, 'b')}, {r('tlo', 7, 'c')}, {r('tla', 7, 'd')} FROM tip""")
oracle("pin_layers", MISSIONS, """SELECT mission_id, CAST(NOT wet AND (mission_id % 4 <> 0 OR NOT (roads OR personality)) AS BIGINT) AS topography, CAST(NOT wet AND roads AS BIGINT) AS roads,
 CAST(NOT wet AND personality AS BIGINT) AS personality, CAST(0 AS BIGINT) AS weather, CAST(wet AS BIGINT) AS sea_drift FROM missions""")
oracle("scatter_samples", RELIEF, f"""SELECT mission_id, CAST("row" // 4 AS BIGINT) AS coarse_row, CAST(col // 4 AS BIGINT) AS coarse_col, {r('CASE WHEN ("row" + col + mission_id) % 3 = 0 THEN 0 ELSE elevation END', 3, 'elevation')} FROM relief WHERE "row" % 4 = 0 AND col % 4 = 0""")

# --- points
oracle("effective_sample_size", f"{DETECTIONS}, w AS (SELECT mission_id, (1 + event_id % 13) / 1000e0 AS w FROM det), e AS (SELECT mission_id, count(*) AS n, 1 / sum(w * w) AS ess FROM w GROUP BY 1)",
       f"SELECT mission_id, n, CAST(ess < n / 2 AS BIGINT) AS resample, {r('ess', 4)} FROM e")
oracle("kde_surface", f"""{PLACED}, pt AS (SELECT mission_id, (1 + event_id % 13) / 1000e0 AS w, row_f - 0.5 AS rf, col_f - 0.5 AS cf FROM placed), ax AS (SELECT CAST(range AS INT) AS i FROM range(32)),
 kd AS (SELECT mission_id, x.i AS "row", y.i AS col, sum(w * exp(-0.5e0 * (power(x.i - rf, 2) + power(y.i - cf, 2)) / 1.21e0)) AS d FROM pt, ax x, ax y WHERE x.i BETWEEN floor(rf - 4) AND ceil(rf + 4) AND y.i BETWEEN floor(cf - 4) AND ceil(cf + 4) GROUP BY 1, 2, 3),
 gr AS (SELECT mission_id, x.i AS "row", y.i AS col FROM pins, ax x, ax y),
 kr AS (SELECT mission_id, "row", col, coalesce(d, 0e0) * (1 + 1.05e0 * {PROX}) AS q FROM gr LEFT JOIN kd USING (mission_id, "row", col))""", f"SELECT {KEYS}, {r('CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE 0 END', 7, 'p')} FROM kr WINDOW w AS (PARTITION BY mission_id)")
oracle("systematic_resample", """pt AS (SELECT event_id % 8 AS mission_id, event_id // 8 AS idx, 1 + event_id * 7 % 13 AS raw FROM events), cu AS (SELECT *, sum(raw) OVER w AS hi, sum(raw) OVER w - raw AS lo, sum(raw) OVER (PARTITION BY mission_id) AS tot, count(*) OVER (PARTITION BY mission_id) AS n FROM pt WINDOW w AS (PARTITION BY mission_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
 dr AS (SELECT *, greatest(0, CAST(floor(lo / tot * n - 0.37e0) AS BIGINT) + 1) AS j0, least(n - 1, CAST(floor(hi / tot * n - 0.37e0) AS BIGINT)) AS j1 FROM cu)""",
       "SELECT mission_id, idx, CAST(j1 - j0 + 1 AS BIGINT) AS copies, CAST(j0 AS BIGINT) AS first_draw FROM dr WHERE j1 >= j0")
oracle("top_points", f"{DETECTIONS}, w AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY (1 + event_id % 13) DESC, event_id DESC) AS rank FROM det)", f"SELECT mission_id, rank, event_id, {r('(1 + event_id % 13) / 1000e0', 6, 'weight')} FROM w WHERE rank <= 20")

# --- flights
_tail_timed = "timed_all AS (SELECT *, CAST(floor((us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) + 1 AS BIGINT) AS tick FROM det)"
SORTIES = f"""{DETECTIONS}, rec AS (SELECT *, user_id % 8 AS sortie FROM det), fl AS (SELECT mission_id, sortie, min(us) AS b, max(us) AS z, bool_or(person) AS found, count(*) AS n FROM rec GROUP BY 1, 2),
 fo AS (SELECT *, (z - b) / 1e6 AS dur, CASE WHEN mission_id % 2 = 0 AND sortie % 2 = 0 THEN 600e0 * sortie END AS ex, row_number() OVER (PARTITION BY mission_id ORDER BY sortie) AS i FROM fl),
 sch AS (SELECT *, coalesce(ex, 120e0) AS st FROM fo WHERE i = 1 UNION ALL SELECT f.*, coalesce(f.ex, s.st + s.dur + 10) FROM sch s JOIN fo f ON f.mission_id = s.mission_id AND f.i = s.i + 1),
 rev AS (SELECT r.*, s.found, s.st, s.dur, st + (us - b) / 1e6 AS rv, lat + CASE r.sortie WHEN 0 THEN 60 WHEN 2 THEN -30 ELSE 0 END / 111320e0 AS la FROM rec r JOIN sch s USING (mission_id, sortie))"""
oracle("sortie_schedule", SORTIES, f"SELECT mission_id, CAST(sortie AS BIGINT) AS sortie, 'drone-' || (sortie + 1) AS asset_id, CAST(found AS BIGINT) AS found, n AS n_records, {r('st', 6, 'start_sec')}, {r('dur', 6, 'duration')} FROM sch")
TRACK = f"""{SORTIES}, sh AS (SELECT *, row_number() OVER (PARTITION BY mission_id, sortie ORDER BY rv DESC, event_id DESC) AS back FROM rev WHERE st < 900000 AND rv < 900000),
 tr AS (SELECT mission_id, sortie, any_value(found) AS found, any_value(st <= 900000 AND 900000 < st + dur) AS active, count(*) AS n, max(la) FILTER (back = 1) AS y2, max(lon) FILTER (back = 1) AS x2, max(la) FILTER (back = 2) AS y1, max(lon) FILTER (back = 2) AS x1 FROM sh GROUP BY 1, 2)"""
_brg = "coalesce((degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360) % 360, 0)"
oracle("drone_tracks", TRACK, f"SELECT mission_id, CAST(sortie AS BIGINT) AS sortie, CAST(found AS BIGINT) AS found, CAST(active AS BIGINT) AS active, n AS n_points, {r('y2', 7, 'lat')}, {r('x2', 7, 'lon')}, {r(_brg, 4, 'heading_deg')} FROM tr")
oracle("track_heads", TRACK, f"SELECT mission_id, arg_max('drone-' || (sortie + 1), CAST(active AS INT) * 100 + sortie) AS asset_id, count(*) AS n_drones, {r('arg_max(y2, CAST(active AS INT) * 100 + sortie)', 7, 'lat')} FROM tr GROUP BY 1")
oracle("trail_segments", f"{SORTIES}, lg AS (SELECT *, lag(lon) OVER w AS x0, lag(la) OVER w AS y0 FROM rev WHERE rv < 900000 WINDOW w AS (PARTITION BY mission_id, sortie ORDER BY rv, event_id))",
       f"""SELECT mission_id, CAST(sortie AS BIGINT) AS sortie, event_id AS record_id, {r('x0', 7, 'from_lon')}, {r('y0', 7, 'from_lat')}, {r('lon', 7, 'to_lon')}, {r('la', 7, 'to_lat')}, {r('rv', 6, 'reveal_sec')}, {r('greatest(0, 1 - (900000 - rv) / CASE WHEN st <= 900000 AND 900000 < st + dur THEN 600000 ELSE 400000 END)', 8, 'opacity')} FROM lg WHERE x0 IS NOT NULL""")
oracle("marker_opacity", f"""{TRACK}, nl AS (SELECT mission_id, sortie, max(rv) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY mission_id, sortie ORDER BY rv, event_id) AS i FROM rev WHERE rv < 900000) WHERE i > 1 GROUP BY 1, 2)""",
       f"SELECT tr.mission_id, CAST(tr.sortie AS BIGINT) AS sortie, {r('CASE WHEN active THEN 1 ELSE coalesce(greatest(0, 1 - (900000 - newest) / 400000e0), 0) END', 8, 'opacity')} FROM tr LEFT JOIN nl USING (mission_id, sortie)")
BOTH = f"""{SORTIES}, {_tail_timed}, bo AS (SELECT mission_id, tick, 'feed' AS source, person, lat, lon FROM timed_all UNION ALL SELECT mission_id, CAST(floor(rv / 3600) + 1 AS BIGINT), 'sortie', person, la, lon FROM rev)"""
oracle("all_evidence", BOTH, f"SELECT mission_id, tick, source, count(*) FILTER (person) AS finds, count(*) FILTER (NOT person) AS sweeps, {r('avg(lat)', 7, 'lat')} FROM bo GROUP BY 1, 2, 3")
oracle("live_sweep", f"""{SORTIES}, px AS (SELECT *, (origin_n + 825e0 - point_n) / 50e0 AS row_f, (point_e - (origin_e - 825e0)) / 50e0 AS col_f FROM {utm('(SELECT * EXCLUDE (lat), la AS lat FROM rev)', 'lat', 'lon', 'point_e', 'point_n')}),
 timed AS MATERIALIZED (SELECT *, CAST(floor(row_f) AS INT) AS "row", CAST(floor(col_f) AS INT) AS col, CAST(floor(rv / 3600) + 1 AS BIGINT) AS tick FROM px WHERE floor(row_f) BETWEEN 0 AND 31 AND floor(col_f) BETWEEN 0 AND 31), {swept(10.0)}""",
       f"SELECT mission_id, tick, CAST(\"row\" AS BIGINT) AS \"row\", CAST(col AS BIGINT) AS col FROM swp")
oracle("subsample", f"""{EVENTS}, rc AS (SELECT event_id, user_id % 3 AS sortie, us, event_type = 'purchase' AND user_id % 5 = 0 AS person FROM ev), ct AS (SELECT sortie, count(*) AS n, count(*) FILTER (person) AS f FROM rc GROUP BY 1),
 ot AS (SELECT rc.*, n, f, row_number() OVER (PARTITION BY rc.sortie ORDER BY us, event_id) - 1 AS k FROM rc JOIN ct USING (sortie) WHERE NOT person),
 pk AS (SELECT sortie, CAST(floor(i * ((n - f) / (300 - f))) AS BIGINT) AS k FROM (SELECT *, unnest(range(0, 300 - f)) AS i FROM ct WHERE n > 300 AND f < 300))""",
       "SELECT event_id, sortie FROM rc JOIN ct USING (sortie) WHERE person OR n <= 300 UNION ALL SELECT event_id, sortie FROM ot JOIN pk USING (sortie, k)")
oracle("mpp_trail", DETECTIONS, f"""SELECT mission_id, CAST(0 AS BIGINT) AS slot, {r('lkp_lat', 8, 'lat')}, {r('lkp_lon', 8, 'lon')} FROM pins UNION ALL SELECT mission_id, CAST(floor((us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) + 2 AS BIGINT) AS slot, {r('avg(lat)', 8, 'lat')}, {r('avg(lon)', 8, 'lon')} FROM det GROUP BY 1, 2""")

# --- messages and payloads
oracle("tick_messages", TRACK, """SELECT mission_id, kind, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS valid FROM (SELECT mission_id, 'heatmap_full' AS kind, 1 AS n FROM pins
  UNION ALL SELECT mission_id, 'heatmap_delta', 1 FROM pins WHERE mission_id % 2 = 0 UNION ALL SELECT mission_id, 'engine_tick', 1 FROM pins
  UNION ALL SELECT mission_id, 'detection_event', count(*) FROM det WHERE person GROUP BY 1 UNION ALL SELECT DISTINCT mission_id, 'drone_track', 1 FROM tr)""")
oracle("latest_state", TRACK, """SELECT mission_id, kind, CAST(2 AS BIGINT) AS tick FROM (SELECT mission_id, 'heatmap_full' AS kind FROM pins UNION ALL SELECT mission_id, 'engine_tick' FROM pins UNION ALL SELECT DISTINCT mission_id, 'drone_track' FROM tr)""")
oracle("message_routing", DETECTIONS, """SELECT mission_id, count(*) AS n, count(DISTINCT event_id % 50) AS frames FROM det WHERE event_id % 3 = 0 GROUP BY 1 UNION ALL SELECT CAST(-1 AS BIGINT), count(*), CAST(0 AS BIGINT) FROM det WHERE event_id % 3 <> 0""")
oracle("mission_status", f"{DETECTIONS}, mx AS (SELECT mission_id, max(CAST(floor((us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) + 1 AS BIGINT)) AS t FROM det GROUP BY 1)", f"SELECT p.mission_id, coalesce(t, 0) AS tick_count, {r('3600', 3, 'step_sec')} FROM pins p LEFT JOIN mx USING (mission_id)")
oracle("overpass_roads", "", "SELECT c_custkey, c_custkey AS way_id, CAST(2 AS BIGINT) AS n, CAST('32.' || (100 + c_custkey % 900) AS DOUBLE) AS lat1, CAST('35.' || (100 + c_custkey % 800) AS DOUBLE) AS lon2 FROM customer")
oracle("assembled_roads", "rf AS (SELECT l_orderkey AS way_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos, p_retailprice AS lat, CAST(p_size AS DOUBLE) AS lon FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 7 <> 0 AND l_orderkey % 5 IN (0, 2, 4))",
       f"SELECT way_id, count(*) AS n, {r('arg_min(lat, pos)', 4, 'lat1')}, {r('arg_max(lon, pos)', 4, 'lon_last')} FROM rf WHERE way_id IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(*) >= 2")
