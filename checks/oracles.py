"""DuckDB statements that state each registered query independently of the operators."""

from __future__ import annotations

import math

from checks.fixtures import with_views
from transitlapse.schema import STEM_COLUMNS

WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MODES = ["rail", "metro", "tram", "bus", "other"]


def hav(a: str, b: str, c: str, d: str, r: str = "6371000e0") -> str:
    """Distance between (lat a, lon b) and (lat c, lon d)."""
    return (f"(2 * {r} * asin(sqrt(least(1e0, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))) + 0 * (({a}) + ({c})))")


def half(x: str, digits: int = 0) -> str:
    if digits == 0:
        return f"CAST(floor(({x}) + 0.5e0) AS BIGINT)"
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def fix6(x: str) -> str:
    return f"printf('%.6f', {half(x, 6)})"


def folded(x: str) -> str:
    return f"replace(regexp_replace(strip_accents(coalesce({x}, '')), '[\\^`¨´¸¯·]', '', 'g'), 'ß', 'ss')"


def norm_stop(x: str) -> str:
    e = f"lower({folded(x)})"
    e = (f"regexp_replace({e}, '(?:[\\s,/-]+)(?:steig|stg\\.?|gleis|gl\\.?|bahnsteig|bstg\\.?|kante|platform|plat\\.?"
         f"|ausgang)[\\s._-]*[0-9a-z]+\\b', ' ', 'g')")
    for words in ("hauptbahnhof|hbf", "bahnhof|bhf", "bahnhst|bst", "haltestelle|hst", "station"):
        e = f"regexp_replace({e}, '\\b({words})\\b', ' ', 'g')"
    e = f"regexp_replace({e}, '\\s*\\([^)]*\\)\\s*$', ' ')"
    e = f"regexp_replace({e}, '[._/\\\\,;:\"''`()\\[\\]{{}}!?*+=<>#]', ' ', 'g')"
    e = f"regexp_replace({e}, '\\s+-\\s+', ' ', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def norm_short(x: str) -> str:
    return f"regexp_replace(upper({folded(x)}), '\\s+', '', 'g')"


def norm_loose(x: str) -> str:
    e = f"regexp_replace(lower({folded(x)}), '[._/\\\\,;:\"''`()\\[\\]{{}}!?*+=<>#-]', ' ', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def slug(x: str) -> str:
    return f"lower(substr(regexp_replace(regexp_replace({x}, '\\s+', '-', 'g'), '[^a-zA-Z0-9-]', '', 'g'), 1, 24))"


def natural(x: str) -> str:
    e = f"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[0-9]+|[^0-9]+')"
    part = "lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 9, '0') || ltrim(t, '0')"
    return f"array_to_string(list_transform({e}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN {part} ELSE t END), '')"


def mode(x: str) -> str:
    return (f"(CASE WHEN {x} = 0 OR {x} BETWEEN 900 AND 906 THEN 'tram' WHEN {x} IN (1, 12) OR {x} BETWEEN 400 AND 405 "
            f"THEN 'metro' WHEN {x} = 2 OR {x} BETWEEN 100 AND 117 OR {x} BETWEEN 300 AND 399 THEN 'rail' "
            f"WHEN {x} IN (3, 11) OR {x} BETWEEN 200 AND 209 OR {x} BETWEEN 700 AND 716 OR {x} BETWEEN 800 AND 802 "
            f"THEN 'bus' ELSE 'other' END)")


def rank(m: str) -> str:
    return f"CAST(list_position(['rail', 'metro', 'tram', 'bus', 'other'], {m}) - 1 AS INTEGER)"


def longest(x: str) -> str:
    return f"first(coalesce({x}, '') ORDER BY length(coalesce({x}, '')) DESC, coalesce({x}, ''))"


def gdate(x: str) -> str:
    return f"CAST(try_strptime(CASE WHEN regexp_matches(trim({x}), '^[0-9]{{8}}$') THEN trim({x}) END, '%Y%m%d') AS DATE)"


def iso(x: str) -> str:
    return (f"(CASE WHEN regexp_matches(trim({x}), '^[0-9]{{8}}$') THEN substr(trim({x}), 1, 4) || '-' || "
            f"substr(trim({x}), 5, 2) || '-' || substr(trim({x}), 7, 2) END)")


def has(stem: str) -> str:
    return f"coalesce(bool_or(stem = '{stem}'), false) AS has_{stem}"


def has_col(stem: str, col: str, name: str) -> str:
    return f"coalesce(bool_or(stem = '{stem}' AND list_contains(string_split(cols, ','), '{col}')), false) AS {name}"


def step(x: str, breaks: list[float]) -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN {x} >= {b}e0 THEN 1 ELSE 0 END)" for b in breaks) + " AS INTEGER)"


def p95(x: str) -> str:
    """Nearest-rank 95th percentile of a group, from its sorted list."""
    return f"list_sort(list({x}))[CAST(ceil(count({x}) * 0.95e0) AS BIGINT)]"


MIN_OF = "(try_cast(split_part({0}, ':', 1) AS INTEGER) * 60 + try_cast(split_part({0}, ':', 2) AS INTEGER))"
DIR = "coalesce(try_cast(t.direction_id AS INTEGER), -1)"
C: dict[str, str] = {}

C["op_caps"] = f"""SELECT feed_id, {has('agency')}, {has('stops')}, {has('routes')}, {has('trips')}, {has('stop_times')},
  {has('calendar')}, {has('shapes')}, {has('feed_info')}, {has_col('routes', 'agency_id', 'has_agency_id')},
  {has_col('routes', 'route_short_name', 'has_short_name')}, {has_col('routes', 'route_long_name', 'has_long_name')},
  {has_col('trips', 'direction_id', 'has_direction_id')}, {has_col('trips', 'trip_headsign', 'has_headsign')},
  {has_col('trips', 'shape_id', 'has_shape_id')}, {has_col('stop_times', 'departure_time', 'has_departure_time')}
  FROM fx_files GROUP BY feed_id"""
C["op_stops"] = """SELECT feed_id, stop_id, coalesce(stop_name, '') AS stop_name, try_cast(stop_lat AS DOUBLE) AS lat,
  try_cast(stop_lon AS DOUBLE) AS lon FROM fx_stops
  WHERE try_cast(stop_lat AS DOUBLE) IS NOT NULL AND try_cast(stop_lon AS DOUBLE) IS NOT NULL"""
C["op_routes"] = f"""SELECT r.feed_id, r.route_id, r.route_short_name AS short_name, r.route_long_name AS long_name,
  r.agency_id, CASE WHEN c.has_agency_id THEN a.agency_name ELSE
    (SELECT first(o.agency_name ORDER BY coalesce(o.agency_id, '')) FROM fx_agency o WHERE o.feed_id = r.feed_id) END AS agency_name,
  try_cast(r.route_type AS INTEGER) AS route_type, {mode('try_cast(r.route_type AS INTEGER)')} AS mode
  FROM fx_routes r JOIN op_caps c ON c.feed_id = r.feed_id
  LEFT JOIN fx_agency a ON a.feed_id = r.feed_id AND a.agency_id = r.agency_id"""
C["op_stopmodes"] = f"""SELECT s.*, coalesce(m.modes, []) AS modes,
  CASE WHEN m.modes IS NULL THEN 'other' ELSE
    ['rail', 'metro', 'tram', 'bus', 'other'][1 + list_min(list_transform(m.modes, lambda x: {rank('x')}))] END AS primary_mode
  FROM op_stops s LEFT JOIN (
    SELECT st.feed_id, st.stop_id, list_sort(list(DISTINCT r.mode)) AS modes FROM fx_stop_times st
    JOIN fx_trips t ON t.feed_id = st.feed_id AND t.trip_id = st.trip_id
    JOIN op_routes r ON r.feed_id = t.feed_id AND r.route_id = t.route_id
    WHERE r.route_type IS NOT NULL GROUP BY 1, 2) m ON m.feed_id = s.feed_id AND m.stop_id = s.stop_id"""
C["op_points"] = """SELECT feed_id, shape_id, try_cast(shape_pt_sequence AS INTEGER) AS seq,
  try_cast(shape_pt_lon AS DOUBLE) AS lon, try_cast(shape_pt_lat AS DOUBLE) AS lat FROM fx_shapes
  WHERE try_cast(shape_pt_lon AS DOUBLE) IS NOT NULL AND try_cast(shape_pt_lat AS DOUBLE) IS NOT NULL"""
C["op_shaperoutes"] = """SELECT feed_id, shape_id, route_id, count(*) AS trips, CAST(row_number() OVER (
  PARTITION BY feed_id, shape_id ORDER BY count(*) DESC, route_id) AS INTEGER) AS rank
  FROM fx_trips WHERE shape_id <> '' GROUP BY feed_id, shape_id, route_id"""
C["op_shapedir"] = f"""SELECT feed_id, shape_id, dir AS direction_id FROM (
  SELECT t.feed_id, t.shape_id, {DIR} AS dir, row_number() OVER (PARTITION BY t.feed_id, t.shape_id
    ORDER BY count(*) DESC, {DIR}) AS rn FROM fx_trips t WHERE t.shape_id <> '' GROUP BY 1, 2, 3) WHERE rn = 1"""
C["op_shapemodes"] = f"""SELECT l.feed_id, l.shape_id, l.coords, coalesce(m.modes, []) AS modes, o.route_id,
  CASE WHEN m.modes IS NULL THEN 'other' ELSE
    ['rail', 'metro', 'tram', 'bus', 'other'][1 + list_min(list_transform(m.modes, lambda x: {rank('x')}))] END AS primary_mode
  FROM (SELECT feed_id, shape_id, '[' || string_agg('[' || {fix6('lon')} || ',' || {fix6('lat')} || ']', ','
    ORDER BY seq, lon, lat) || ']' AS coords FROM op_points GROUP BY 1, 2) l
  LEFT JOIN (SELECT s.feed_id, s.shape_id, list_sort(list(DISTINCT r.mode)) AS modes FROM op_shaperoutes s
    JOIN op_routes r ON r.feed_id = s.feed_id AND r.route_id = s.route_id WHERE r.route_type IS NOT NULL GROUP BY 1, 2) m
    ON m.feed_id = l.feed_id AND m.shape_id = l.shape_id
  LEFT JOIN op_shaperoutes o ON o.feed_id = l.feed_id AND o.shape_id = l.shape_id AND o.rank = 1"""
C["op_lines"] = f"""SELECT x.feed_id, x.stop_id, x.route_id, coalesce(r.short_name, '') AS short_name,
  coalesce(r.long_name, '') AS long_name, coalesce(r.agency_name, '') AS agency_name, r.route_type, r.mode, x.trip_count
  FROM (SELECT st.feed_id, st.stop_id, t.route_id, count(DISTINCT t.trip_id) AS trip_count FROM fx_stop_times st
    JOIN fx_trips t ON t.feed_id = st.feed_id AND t.trip_id = st.trip_id GROUP BY 1, 2, 3) x
  JOIN op_routes r ON r.feed_id = x.feed_id AND r.route_id = x.route_id"""
C["op_cal"] = f"""SELECT feed_id, service_id, {' + '.join(f'coalesce(try_cast({d} AS INTEGER), 0)' for d in WEEK)} AS days
  FROM fx_calendar"""
C["op_weekly"] = """SELECT t.feed_id, t.route_id, CAST(sum(CASE WHEN c.has_calendar THEN k.days ELSE 1 END) AS DOUBLE) AS trips_per_week
  FROM fx_trips t JOIN op_caps c ON c.feed_id = t.feed_id
  LEFT JOIN op_cal k ON k.feed_id = t.feed_id AND k.service_id = t.service_id
  WHERE NOT c.has_calendar OR k.days IS NOT NULL GROUP BY 1, 2"""
C["op_feedweekly"] = """SELECT f.feed_id, coalesce(w.n, 0e0) AS trips_per_week FROM fx_feeds f LEFT JOIN (
  SELECT feed_id, sum(trips_per_week) AS n FROM op_weekly GROUP BY 1) w ON w.feed_id = f.feed_id"""
C["op_departures"] = f"""SELECT st.feed_id, st.stop_id, count(*) AS departures FROM fx_stop_times st
  JOIN op_caps c ON c.feed_id = st.feed_id AND c.has_departure_time
  LEFT JOIN fx_trips t ON c.has_calendar AND t.feed_id = st.feed_id AND t.trip_id = st.trip_id
  LEFT JOIN fx_calendar k ON k.feed_id = t.feed_id AND k.service_id = t.service_id AND k.wednesday = '1'
  WHERE {MIN_OF.format('st.departure_time')} BETWEEN 360 AND 1200 AND (NOT c.has_calendar OR k.service_id IS NOT NULL)
  GROUP BY 1, 2"""
C["op_patterns"] = f"""SELECT t.feed_id, t.route_id, t.trip_id, {DIR} AS dir, coalesce(t.trip_headsign, '') AS headsign,
  string_agg(st.stop_id, '|' ORDER BY try_cast(st.stop_sequence AS INTEGER), st.stop_id) AS pattern, count(*) AS stop_count
  FROM fx_trips t JOIN fx_stop_times st ON st.feed_id = t.feed_id AND st.trip_id = t.trip_id GROUP BY 1, 2, 3, 4, 5"""
C["op_patterngroups"] = """SELECT feed_id, route_id, dir, count(*) AS trip_count, max(stop_count) AS stop_count,
  min(trip_id) AS sample_trip_id, first(headsign ORDER BY trip_id) AS headsign FROM op_patterns
  GROUP BY feed_id, route_id, dir, pattern"""
C["op_directions"] = """SELECT *, CAST(row_number() OVER w AS INTEGER) AS pos,
    last_value(stop_name) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_stop,
    count(*) OVER (PARTITION BY feed_id, route_id, dir) AS n_stops
  FROM (SELECT g.feed_id, g.route_id, g.dir, g.trip_count, g.headsign, try_cast(st.stop_sequence AS INTEGER) AS seq,
      s.stop_id, s.stop_name, s.lat, s.lon
    FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, route_id, dir
        ORDER BY stop_count DESC, trip_count DESC, sample_trip_id) AS rn FROM op_patterngroups) g
    JOIN fx_stop_times st ON st.feed_id = g.feed_id AND st.trip_id = g.sample_trip_id
    JOIN op_stops s ON s.feed_id = st.feed_id AND s.stop_id = st.stop_id WHERE g.rn = 1)
  WINDOW w AS (PARTITION BY feed_id, route_id, dir ORDER BY seq, stop_id)"""
C["op_lengths"] = f"""SELECT feed_id, shape_id, coalesce(sum({hav('p_lat', 'p_lon', 'lat', 'lon')}), 0e0) AS length_m, count(*) AS points
  FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM op_points
    WINDOW w AS (PARTITION BY feed_id, shape_id ORDER BY seq, lon, lat)) GROUP BY 1, 2"""
C["op_counts"] = """SELECT f.feed_id,
  CASE WHEN c.has_stops THEN (SELECT count(*) FROM fx_stops s WHERE s.feed_id = f.feed_id) END AS stop_count,
  CASE WHEN c.has_routes THEN (SELECT count(*) FROM fx_routes s WHERE s.feed_id = f.feed_id) END AS route_count,
  CASE WHEN c.has_trips THEN (SELECT count(*) FROM fx_trips s WHERE s.feed_id = f.feed_id) END AS trip_count
  FROM fx_feeds f LEFT JOIN op_caps c ON c.feed_id = f.feed_id"""
C["op_dates"] = """SELECT f.feed_id, CASE WHEN i.s IS NOT NULL OR i.e IS NOT NULL THEN i.s ELSE k.s END AS start_date,
  CASE WHEN i.s IS NOT NULL OR i.e IS NOT NULL THEN i.e ELSE k.e END AS end_date
  FROM fx_feeds f
  LEFT JOIN (SELECT feed_id, nullif(feed_start_date, '') AS s, nullif(feed_end_date, '') AS e FROM fx_feed_info) i ON i.feed_id = f.feed_id
  LEFT JOIN (SELECT feed_id, min(start_date) AS s, max(end_date) AS e FROM fx_calendar GROUP BY 1) k ON k.feed_id = f.feed_id"""
C["op_years"] = f"""SELECT feed_id, source_name, loaded_at, start_date, end_date, rep_ms,
    CAST(epoch_ms(rep_ms) AS DATE) AS rep_date, CAST(year(epoch_ms(rep_ms)) AS INTEGER) AS year,
    CASE WHEN known THEN least(d1, d2) END AS span_start, CASE WHEN known THEN greatest(d1, d2) END AS span_end,
    NOT known AS synthetic
  FROM (SELECT *, d1 IS NOT NULL AND d2 IS NOT NULL AS known, CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL THEN
      CAST(floor((epoch(d1) + epoch(d2)) / 86400 / 2) AS BIGINT) * 86400000 ELSE loaded_at END AS rep_ms
    FROM (SELECT f.*, d.start_date, d.end_date, {gdate('d.start_date')} AS d1, {gdate('d.end_date')} AS d2
      FROM fx_feeds f JOIN op_dates d ON d.feed_id = f.feed_id))"""
C["op_labels"] = r"""SELECT feed_id, trim(regexp_replace(regexp_replace(source_name, '\.zip$', '', 'i'), '\s*\(\d{4}\)\s*$', ''))
  || ' (' || year || ')' AS label FROM op_years"""
C["op_yearlabels"] = """SELECT feed_id, year, rep_ms, CASE WHEN count(*) OVER (PARTITION BY year) <= 1 THEN CAST(year AS VARCHAR)
  WHEN count(*) OVER (PARTITION BY year, month(rep_date)) <= 1 THEN strftime(rep_date, '%Y-%m')
  ELSE strftime(rep_date, '%Y-%m-%d') END AS year_label FROM op_years"""
C["op_trend"] = f"""SELECT y.feed_id, y.rep_ms, y.year_label AS year, l.label AS feed, c.stop_count AS stops, c.route_count AS routes,
  c.trip_count AS trips, {iso('d.start_date')} AS service_start, {iso('d.end_date')} AS service_end, w.trips_per_week AS weekly_trips
  FROM op_yearlabels y JOIN op_labels l ON l.feed_id = y.feed_id JOIN op_counts c ON c.feed_id = y.feed_id
  JOIN op_dates d ON d.feed_id = y.feed_id JOIN op_feedweekly w ON w.feed_id = y.feed_id"""
C["op_steps"] = """SELECT feed_a, feed_b FROM (SELECT lag(feed_id) OVER (ORDER BY rep_ms, feed_id) AS feed_a, feed_id AS feed_b
  FROM op_years) WHERE feed_a IS NOT NULL"""
C["op_auto"] = """SELECT first(feed_id ORDER BY rep_ms, feed_id) AS feed_a, first(feed_id ORDER BY rep_ms DESC, feed_id DESC) AS feed_b FROM op_years"""
C["op_pairs"] = "SELECT * FROM op_steps UNION SELECT * FROM op_auto"

# ---- registry ----
C["op_keys"] = f"""SELECT feed_id, stop_id AS raw_id, stop_name AS name, lat, lon, {norm_stop('stop_name')} AS name_key,
  row_number() OVER (ORDER BY feed_id || chr(9) || stop_id) AS n, feed_id || chr(9) || stop_id AS key FROM op_stops"""
C["op_near"] = f"""SELECT a.n AS a, b.n AS b FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM op_keys) a
  JOIN op_keys b ON CAST(floor(a.lat * 4000) AS BIGINT) + a.dy = CAST(floor(b.lat * 4000) AS BIGINT) AND a.n <> b.n
    AND abs(a.lon - b.lon) < 0.0005 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25"""
C["op_reach"] = """/*RECURSIVE*/SELECT n, n AS m FROM op_keys UNION SELECT op_reach.n, e.b FROM op_reach JOIN op_near e ON e.a = op_reach.m"""
C["op_scope"] = "SELECT n, min(m) AS scope, count(*) AS members FROM op_reach GROUP BY n"
C["op_raw"] = f"""SELECT a.n AS a, b.n AS b FROM op_keys a JOIN op_keys b ON a.raw_id = b.raw_id AND a.feed_id <> b.feed_id
  AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200"""
C["op_ident"] = """SELECT a.n AS a, b.n AS b FROM (SELECT k.n, k.name_key, s.scope FROM op_keys k JOIN op_scope s ON s.n = k.n) a
  JOIN (SELECT k.n, k.name_key, s.scope FROM op_keys k JOIN op_scope s ON s.n = k.n) b
  ON a.scope = b.scope AND a.name_key = b.name_key AND a.n <> b.n UNION SELECT a, b FROM op_raw"""
C["op_merge"] = """/*RECURSIVE*/SELECT n, n AS m FROM op_keys UNION SELECT op_merge.n, e.b FROM op_merge JOIN op_ident e ON e.a = op_merge.m"""
C["op_group"] = """SELECT k.*, g.component FROM op_keys k JOIN (SELECT n, min(m) AS component FROM op_merge GROUP BY n) g ON g.n = k.n"""


def summary(src: str, by: str) -> str:
    return f"""SELECT b.{by}, coalesce(nullif(b.name, ''), '(unnamed)') AS name, r.name_key, b.lat_sum / b.member_count AS lat,
  b.lon_sum / b.member_count AS lon, b.member_count, b.feed_count
  FROM (SELECT {by}, CAST(sum(CAST(lat AS DECIMAL(18, 9))) AS DOUBLE) AS lat_sum, CAST(sum(CAST(lon AS DECIMAL(18, 9))) AS DOUBLE) AS lon_sum,
    count(*) AS member_count, count(DISTINCT feed_id) AS feed_count, {longest('name')} AS name FROM {src} GROUP BY 1) b
  JOIN (SELECT {by}, name_key, row_number() OVER (PARTITION BY {by} ORDER BY count(*) - CASE WHEN name_key = '' THEN 0.5 ELSE 0 END DESC,
    max(length(name)) DESC, name_key) AS rn FROM {src} GROUP BY 1, 2) r ON r.{by} = b.{by} AND r.rn = 1"""


LAT6, LON6 = half("lat * 1e6"), half("lon * 1e6")
C["op_summary"] = summary("op_group", "component")
C["op_members"] = f"""SELECT g.feed_id, g.raw_id, g.name, g.name_key, g.lat, g.lon, i.canonical_id FROM op_group g JOIN (
  SELECT component, 's_' || CASE WHEN {LAT6} < 0 THEN 'S' ELSE 'N' END || abs({LAT6}) || '_' || CASE WHEN {LON6} < 0 THEN 'W' ELSE 'E' END
    || abs({LON6}) || '_' || coalesce(nullif(regexp_replace(substr(name_key, 1, 24), '\\s+', '-', 'g'), ''), 'unnamed')
    || CASE WHEN length(name_key) > 24 OR contains(name_key, '-') OR name_key = 'unnamed' THEN '_' || substr(md5(name_key), 1, 16) ELSE '' END AS canonical_id
  FROM op_summary) i ON i.component = g.component"""
C["op_canonstops"] = summary("op_members", "canonical_id")
AKEY = (f"(CASE WHEN {norm_loose('agency_name')} <> '' THEN 'n:' || {norm_loose('agency_name')} "
        f"WHEN trim(coalesce(agency_id, '')) <> '' THEN 'i:' || lower(trim(agency_id)) ELSE '__none__' END)")
NKEY = f"(CASE WHEN {norm_short('short_name')} <> '' THEN {norm_short('short_name')} ELSE {norm_loose('long_name')} END)"
C["op_rmembers"] = f"""SELECT *, route_id AS raw_id, 'r_' || coalesce(nullif({slug(AKEY)}, ''), 'none') || '_' || mode || '_' ||
  coalesce(nullif({slug(NKEY)}, ''), 'none') || CASE WHEN ({AKEY} = '__none__' OR (regexp_matches({AKEY}, '^[ni]:[a-z0-9 ]{{1,23}}$') AND {slug(AKEY)} <> 'none'))
    AND ({NKEY} = '' OR (regexp_matches({NKEY}, '^[A-Z0-9]{{1,24}}$') AND {NKEY} <> 'NONE')) THEN ''
    ELSE '_' || substr(md5({AKEY} || '|' || mode || '|' || {NKEY}), 1, 16) END AS canonical_id FROM op_routes"""
C["op_canonroutes"] = f"""SELECT canonical_id, {longest('short_name')} AS short_name, {longest('long_name')} AS long_name,
  coalesce(nullif({longest('agency_name')}, ''), min(agency_id), '') AS agency, min(mode) AS mode, count(*) AS member_count,
  count(DISTINCT feed_id) AS feed_count FROM op_rmembers GROUP BY 1"""


def overridden(kind: str, members: str, canon: str, name: str) -> None:
    """Overrides replayed: unmerges, then for every merge the group its first member had moved to before."""
    p = f"op_{kind}ov"
    C[f"{p}base"] = f"""SELECT m.*, CASE WHEN u.raw_id IS NULL THEN m.canonical_id ELSE m.canonical_id || '__split__' || m.feed_id || '_'
      || m.raw_id END AS cid, u.raw_id IS NOT NULL AS split FROM {members} m LEFT JOIN (
      SELECT DISTINCT feed_id, raw_id FROM fx_overrides WHERE kind = '{kind}' AND op = 'unmerge') u
      ON u.feed_id = m.feed_id AND u.raw_id = m.raw_id"""
    C[f"{p}first"] = f"""SELECT o.group_id, o.feed_id, o.raw_id, b.cid, o.label FROM fx_overrides o JOIN {p}base b
      ON b.feed_id = o.feed_id AND b.raw_id = o.raw_id WHERE o.kind = '{kind}' AND o.op = 'merge' AND o.pos = 0 AND o.group_id IN (
        SELECT group_id FROM fx_overrides WHERE kind = '{kind}' AND op = 'merge' GROUP BY 1 HAVING count(*) >= 2)"""
    C[f"{p}move"] = f"""SELECT o.group_id, o.feed_id, o.raw_id FROM fx_overrides o JOIN {p}base b ON b.feed_id = o.feed_id
      AND b.raw_id = o.raw_id WHERE o.kind = '{kind}' AND o.op = 'merge' AND o.pos > 0 AND o.group_id IN (SELECT group_id FROM {p}first)"""
    C[f"{p}chain"] = f"""/*RECURSIVE*/SELECT f.group_id, f.label, f.group_id AS at, f.cid, 0 AS hops FROM {p}first f
      UNION ALL SELECT c.group_id, c.label, q.parent, f.cid, c.hops + 1 FROM {p}chain c JOIN (
        SELECT f.group_id, max(m.group_id) AS parent FROM {p}first f JOIN {p}move m ON m.feed_id = f.feed_id AND m.raw_id = f.raw_id
        AND m.group_id < f.group_id GROUP BY 1) q ON q.group_id = c.at JOIN {p}first f ON f.group_id = q.parent"""
    C[f"{p}target"] = f"SELECT group_id, first(label) AS label, first(cid ORDER BY hops DESC) AS target FROM {p}chain GROUP BY 1"
    C[f"{p}final"] = f"""SELECT b.*, coalesce(t.target, b.cid) AS final_id FROM {p}base b LEFT JOIN (
      SELECT feed_id, raw_id, max(group_id) AS group_id FROM {p}move GROUP BY 1, 2) l ON l.feed_id = b.feed_id AND l.raw_id = b.raw_id
      LEFT JOIN {p}target t ON t.group_id = l.group_id"""
    label = f"(SELECT first(t.label ORDER BY t.group_id DESC) FROM {p}target t WHERE t.label <> '' AND t.target = x.final_id)"
    shown = f"coalesce({label}, n.name)" if kind == "stop" else "n.name"
    C[f"{p}canon"] = f"""SELECT x.final_id AS canonical_id, {shown} AS name, x.member_count, x.feed_count FROM (
      SELECT final_id, count(*) AS member_count, count(DISTINCT feed_id) AS feed_count FROM {p}final GROUP BY 1) x
      JOIN (SELECT canonical_id, {name} AS name FROM {canon} UNION ALL SELECT f.cid, c.{name} FROM {p}base f
        JOIN {canon} c ON c.canonical_id = f.canonical_id WHERE f.split) n ON n.canonical_id = x.final_id"""


overridden("stop", "op_members", "op_canonstops", "name")
overridden("route", "op_rmembers", "op_canonroutes", "long_name")
C["op_judged"] = """SELECT t.*, a.canonical_id AS canonical_a, b.canonical_id AS canonical_b, a.canonical_id = b.canonical_id AS predicted
  FROM fx_truth t
  LEFT JOIN (SELECT 'stop' AS kind, feed_id, raw_id, canonical_id FROM op_members UNION ALL
    SELECT 'route', feed_id, raw_id, canonical_id FROM op_rmembers) a ON a.kind = t.kind AND a.feed_id = t.feed_a AND a.raw_id = t.raw_a
  LEFT JOIN (SELECT 'stop' AS kind, feed_id, raw_id, canonical_id FROM op_members UNION ALL
    SELECT 'route', feed_id, raw_id, canonical_id FROM op_rmembers) b ON b.kind = t.kind AND b.feed_id = t.feed_b AND b.raw_id = t.raw_b"""

# ---- diff ----
C["op_sides"] = f"""SELECT feed_id, canonical_id, {longest('name')} AS name, CAST(sum(CAST(lat AS DECIMAL(18, 9))) AS DOUBLE) / count(*) AS lat,
  CAST(sum(CAST(lon AS DECIMAL(18, 9))) AS DOUBLE) / count(*) AS lon, count(*) AS raw_count FROM op_members GROUP BY 1, 2"""
C["op_stopdiff"] = f"""SELECT *, CASE WHEN status = 'moved' AND renamed THEN 'moved + renamed' ELSE status END AS label FROM (
  SELECT *, CASE WHEN b_name IS NULL THEN 'removed' WHEN a_name IS NULL THEN 'added' WHEN moved THEN 'moved' WHEN renamed THEN 'renamed'
    ELSE 'unchanged' END AS status FROM (
  SELECT *, dist_m > 15 AS moved, a_name IS NOT NULL AND b_name IS NOT NULL AND {norm_stop('a_name')} <> {norm_stop('b_name')} AS renamed
  FROM (SELECT *, CASE WHEN a_name IS NULL OR b_name IS NULL THEN 0e0 ELSE {hav('a_lat', 'a_lon', 'b_lat', 'b_lon')} END AS dist_m FROM (
    SELECT coalesce(a.feed_a, b.feed_a) AS feed_a, coalesce(a.feed_b, b.feed_b) AS feed_b, coalesce(a.canonical_id, b.canonical_id) AS canonical_id,
      a.name AS a_name, a.lat AS a_lat, a.lon AS a_lon, a.raw_count AS a_raw_count, b.name AS b_name, b.lat AS b_lat, b.lon AS b_lon,
      b.raw_count AS b_raw_count
    FROM (SELECT p.*, s.* FROM op_pairs p JOIN op_sides s ON s.feed_id = p.feed_a) a
    FULL JOIN (SELECT p.*, s.* FROM op_pairs p JOIN op_sides s ON s.feed_id = p.feed_b) b
    ON a.feed_a = b.feed_a AND a.feed_b = b.feed_b AND a.canonical_id = b.canonical_id))))"""
C["op_rsides"] = f"""SELECT m.feed_id, m.canonical_id, {longest('m.short_name')} AS short_name, {longest('m.long_name')} AS long_name,
  {longest('m.agency_name')} AS agency_name, first(c.mode) AS mode, count(*) AS raw_count FROM op_rmembers m
  JOIN op_canonroutes c ON c.canonical_id = m.canonical_id GROUP BY 1, 2"""
RF = ["short_name", "long_name", "agency_name", "mode", "raw_count"]
C["op_rbase"] = f"""SELECT *, CASE WHEN b_mode IS NULL THEN 'removed' WHEN a_mode IS NULL THEN 'added'
    WHEN {norm_loose('a_long_name')} <> {norm_loose('b_long_name')} OR {norm_loose('a_agency_name')} <> {norm_loose('b_agency_name')}
    THEN 'modified' ELSE 'unchanged' END AS status FROM (
  SELECT coalesce(a.feed_a, b.feed_a) AS feed_a, coalesce(a.feed_b, b.feed_b) AS feed_b, coalesce(a.canonical_id, b.canonical_id) AS canonical_id,
    {', '.join(f'{s}.{f} AS {s}_{f}' for s in 'ab' for f in RF)}
  FROM (SELECT p.*, s.* FROM op_pairs p JOIN op_rsides s ON s.feed_id = p.feed_a) a
  FULL JOIN (SELECT p.*, s.* FROM op_pairs p JOIN op_rsides s ON s.feed_id = p.feed_b) b
  ON a.feed_a = b.feed_a AND a.feed_b = b.feed_b AND a.canonical_id = b.canonical_id)"""
C["op_rlone"] = f"""SELECT *, row_number() OVER (PARTITION BY feed_a, feed_b, fp, status ORDER BY canonical_id) AS n
  FROM (SELECT *, coalesce(nullif({norm_loose('coalesce(a_agency_name, b_agency_name)')}, ''), '__none__') || '|' || coalesce(a_mode, b_mode)
    || '|' || {norm_loose('coalesce(a_long_name, b_long_name)')} AS fp FROM op_rbase
    WHERE status IN ('added', 'removed') AND {norm_loose('coalesce(a_long_name, b_long_name)')} <> '')"""
C["op_ren"] = f"""SELECT r.feed_a, r.feed_b, r.canonical_id AS from_id, a.canonical_id AS to_id, {', '.join(f'r.a_{f}' for f in RF)},
  {', '.join(f'a.b_{f}' for f in RF)} FROM op_rlone r JOIN op_rlone a ON a.feed_a = r.feed_a AND a.feed_b = r.feed_b AND a.fp = r.fp
  AND a.n = r.n AND r.status = 'removed' AND a.status = 'added'"""
C["op_routediff"] = f"""SELECT feed_a, feed_b, canonical_id, status, CAST(NULL AS VARCHAR) AS from_id, CAST(NULL AS VARCHAR) AS to_id, {', '.join(f'{s}_{f}' for s in 'ab' for f in RF)}
  FROM op_rbase b WHERE NOT EXISTS (SELECT 1 FROM op_ren r WHERE r.feed_a = b.feed_a AND r.feed_b = b.feed_b
    AND b.canonical_id IN (r.from_id, r.to_id))
  UNION ALL SELECT feed_a, feed_b, 'ren__' || from_id || '__' || to_id, 'renumbered', from_id, to_id,
    {', '.join(f'{s}_{f}' for s in 'ab' for f in RF)} FROM op_ren"""
C["op_entryroutes"] = """SELECT d.feed_a, d.feed_b, d.canonical_id AS entry_id, d.status, 'a' AS side, m.feed_id, m.raw_id FROM op_routediff d
  JOIN op_rmembers m ON m.feed_id = d.feed_a AND m.canonical_id = coalesce(d.from_id, d.canonical_id)
  UNION ALL SELECT d.feed_a, d.feed_b, d.canonical_id, d.status, 'b', m.feed_id, m.raw_id FROM op_routediff d
  JOIN op_rmembers m ON m.feed_id = d.feed_b AND m.canonical_id = coalesce(d.to_id, d.canonical_id)"""
C["op_entrystops"] = """SELECT d.feed_a, d.feed_b, d.canonical_id AS entry_id, d.status, 'a' AS side, m.feed_id, m.raw_id FROM op_stopdiff d
  JOIN op_members m ON m.feed_id = d.feed_a AND m.canonical_id = d.canonical_id
  UNION ALL SELECT d.feed_a, d.feed_b, d.canonical_id, d.status, 'b', m.feed_id, m.raw_id FROM op_stopdiff d
  JOIN op_members m ON m.feed_id = d.feed_b AND m.canonical_id = d.canonical_id"""
C["op_statuses"] = """SELECT feed_a, feed_b, 'stops' AS kind, status, count(*) AS entries FROM op_stopdiff GROUP BY ALL
  UNION ALL SELECT feed_a, feed_b, 'routes', status, count(*) FROM op_routediff GROUP BY ALL"""

# ---- frequency ----
C["op_drawn"] = """SELECT DISTINCT t.feed_id, t.route_id FROM fx_trips t WHERE EXISTS (
  SELECT 1 FROM op_points p WHERE p.feed_id = t.feed_id AND p.shape_id = t.shape_id)"""
C["op_drawnweekly"] = """SELECT r.feed_id, r.route_id, coalesce(w.trips_per_week, 0e0) AS trips_per_week
  FROM (SELECT DISTINCT feed_id, route_id FROM fx_routes) r JOIN op_drawn d ON d.feed_id = r.feed_id AND d.route_id = r.route_id
  LEFT JOIN op_weekly w ON w.feed_id = r.feed_id AND w.route_id = r.route_id"""
C["op_freqscale"] = f"""SELECT *, CASE WHEN p_value > 0 THEN p_value ELSE top END AS scale FROM (
  SELECT feed_id, {p95('trips_per_week')} AS p_value, max(trips_per_week) AS top FROM op_drawnweekly GROUP BY 1)"""
C["op_feedfreq"] = f"""SELECT d.feed_id, d.route_id, d.trips_per_week, s.top AS max_weekly, s.scale AS scale_weekly,
  greatest(0e0, least(1e0, d.trips_per_week / CASE WHEN s.scale > 0 THEN s.scale ELSE 1e0 END)) AS trips_norm,
  {step('d.trips_per_week', [50, 150, 400, 800])} AS class FROM op_drawnweekly d JOIN op_freqscale s ON s.feed_id = d.feed_id"""
C["op_freqdiff"] = """SELECT d.feed_a, d.feed_b, d.canonical_id, c.short_name, c.long_name, c.mode, d.status, x.trips_a, x.trips_b,
  x.trips_b - x.trips_a AS delta FROM op_routediff d JOIN op_canonroutes c ON c.canonical_id = coalesce(d.to_id, d.canonical_id)
  JOIN (SELECT e.feed_a, e.feed_b, e.entry_id, sum(CASE WHEN e.side = 'a' THEN coalesce(w.trips_per_week, 0) ELSE 0e0 END) AS trips_a,
      sum(CASE WHEN e.side = 'b' THEN coalesce(w.trips_per_week, 0) ELSE 0e0 END) AS trips_b, count(q.route_id) AS drawn
    FROM op_entryroutes e LEFT JOIN op_weekly w ON w.feed_id = e.feed_id AND w.route_id = e.raw_id
    LEFT JOIN op_drawn q ON q.feed_id = e.feed_id AND q.route_id = e.raw_id GROUP BY 1, 2, 3) x
  ON x.feed_a = d.feed_a AND x.feed_b = d.feed_b AND x.entry_id = d.canonical_id AND x.drawn > 0"""


def scaled(src: str) -> str:
    pct = "(CASE WHEN trips_a > 0 THEN delta / trips_a WHEN trips_b > 0 THEN 3e0 ELSE 0e0 END)"
    return f"""SELECT feed_a, feed_b, canonical_id, short_name, long_name, mode, status, trips_a, trips_b, delta, max_abs_delta,
      scale_abs_delta, {half('greatest(-1e0, least(1e0, delta / CASE WHEN scale_abs_delta > 0 THEN scale_abs_delta ELSE 1e0 END))', 6)} AS delta_norm,
      {half('percent_delta', 6)} AS percent_delta, {step('percent_delta', [-0.5, -0.15, 0.15, 0.5])} AS relative_class,
      {step('delta', [-50, -10, 10, 50])} AS absolute_class
      FROM (SELECT f.*, s.top AS max_abs_delta, CASE WHEN s.p > 0 THEN s.p ELSE s.top END AS scale_abs_delta,
        greatest(-1e0, least(3e0, {pct})) AS percent_delta FROM ({src}) f
        JOIN (SELECT feed_a, feed_b, {p95('abs(delta)')} AS p, max(abs(delta)) AS top FROM ({src}) GROUP BY 1, 2) s
        ON s.feed_a = f.feed_a AND s.feed_b = f.feed_b)"""


# ---- timeline ----
C["op_churn"] = """SELECT DISTINCT d.canonical_id, d.status FROM op_stopdiff d JOIN op_steps s ON s.feed_a = d.feed_a AND s.feed_b = d.feed_b
  WHERE d.status IN ('added', 'removed')"""


def per_status(src: str, prefix: str, names: list[str]) -> str:
    return f"SELECT feed_a, feed_b, {', '.join(f'''count(*) FILTER (WHERE status = '{n}') AS {prefix}_{n}''' for n in names)} FROM {src} GROUP BY 1, 2"


SN = ["added", "removed", "moved", "renamed", "unchanged"]
RN = ["added", "removed", "renumbered", "modified", "unchanged"]
C["op_change"] = f"""SELECT s.feed_a, s.feed_b, CASE WHEN p.feed_a IS NULL THEN s.stops_added ELSE (SELECT count(*) FROM op_churn WHERE status = 'added') END AS stops_added,
  CASE WHEN p.feed_a IS NULL THEN s.stops_removed ELSE (SELECT count(*) FROM op_churn WHERE status = 'removed') END AS stops_removed,
  s.stops_moved, s.stops_renamed, s.stops_unchanged, {', '.join(f'r.routes_{n}' for n in RN)},
  coalesce(f.freq_gain, 0) AS freq_gain, coalesce(f.freq_loss, 0) AS freq_loss, ca.trip_count AS trips_a, {iso('da.start_date')} AS span_start_a,
  {iso('da.end_date')} AS span_end_a, cb.trip_count AS trips_b, {iso('db.start_date')} AS span_start_b, {iso('db.end_date')} AS span_end_b,
  s.stops_added AS net_stops_added, s.stops_removed AS net_stops_removed, cb.trip_count - ca.trip_count AS trip_delta
  FROM ({per_status('op_stopdiff', 'stops', SN)}) s JOIN ({per_status('op_routediff', 'routes', RN)}) r ON r.feed_a = s.feed_a AND r.feed_b = s.feed_b
  LEFT JOIN op_auto p ON p.feed_a = s.feed_a AND p.feed_b = s.feed_b
  LEFT JOIN (SELECT feed_a, feed_b, count(*) FILTER (WHERE delta > 0) AS freq_gain, count(*) FILTER (WHERE delta < 0) AS freq_loss FROM op_freqdiff
    WHERE status NOT IN ('added', 'removed') GROUP BY 1, 2) f ON f.feed_a = s.feed_a AND f.feed_b = s.feed_b
  JOIN op_counts ca ON ca.feed_id = s.feed_a JOIN op_counts cb ON cb.feed_id = s.feed_b
  JOIN op_dates da ON da.feed_id = s.feed_a JOIN op_dates db ON db.feed_id = s.feed_b"""

# ---- grades ----
C["op_ranked"] = f"""SELECT * FROM (SELECT *, CASE interval_class
    WHEN 0 THEN [1, 1, 2, 3] WHEN 1 THEN [1, 2, 3, 3] WHEN 2 THEN [2, 3, 4, 4] WHEN 3 THEN [3, 4, 5, 5] WHEN 4 THEN [4, 5, 6, 6]
    WHEN 5 THEN [5, 6, 7, 7] WHEN 6 THEN [NULL, 7, 8, 8] ELSE [NULL, NULL, NULL, NULL] END[mode_category] AS category
  FROM (SELECT *, CASE WHEN interval_min < 5 THEN 0 WHEN interval_min <= 10 THEN 1 WHEN interval_min < 20 THEN 2 WHEN interval_min <= 40 THEN 3
      WHEN interval_min <= 60 THEN 4 WHEN interval_min <= 120 THEN 5 WHEN interval_min <= 210 THEN 6 ELSE 7 END AS interval_class,
    CASE WHEN primary_mode IN ('rail', 'metro') THEN 2 WHEN primary_mode = 'tram' THEN 3 ELSE 4 END AS mode_category
  FROM (SELECT s.*, d.departures, 840e0 / (d.departures * 0.5e0) AS interval_min FROM op_stopmodes s
    JOIN op_departures d ON d.feed_id = s.feed_id AND d.stop_id = s.stop_id))) WHERE category IS NOT NULL"""

from types import SimpleNamespace  # noqa: E402

# Requested windows on the two lattices, stated on their own: first pixel, pixels, west, north, cell size.
_PER_DEGREE = 1 / 0.0008333333300327
POP_VIEW, POP_EXTENT = (13.2, 47.1, 14.6, 47.7), (13.0, 47.0, 15.1, 48.0)


def window(west: float, north: float, box: tuple[float, float, float, float]) -> SimpleNamespace:
    px = lambda deg: math.floor(deg * _PER_DEGREE + 0.5)
    left, top = px(box[0] - west), px(north - box[3])
    cols, rows = px(box[2] - west) - left, px(north - box[1]) - top
    return SimpleNamespace(left=left, top=top, cols=cols, rows=rows, west=west + left / _PER_DEGREE,
                           north=north - top / _PER_DEGREE, cell_x=1 / _PER_DEGREE, cell_y=1 / _PER_DEGREE)


_W = window(-20.0, 60.0, (13.0, 47.0, 14.9, 47.9))


def num(x: float) -> str:
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


CLAT = f"({num(_W.north)} - (r.row + 0.5e0) * {num(_W.cell_y)})"
CLON = f"({num(_W.west)} + (c.col + 0.5e0) * {num(_W.cell_x)})"
C["op_gridraw"] = f"""SELECT feed_id, row, col, grade, dist_m, category FROM (
  SELECT s.feed_id, r.row, c.col, s.category, {hav('s.lat', 's.lon', CLAT, CLON)} AS dist_m
  FROM (SELECT DISTINCT feed_id, lat, lon, category FROM op_ranked) s
  JOIN LATERAL (SELECT unnest(range(greatest(0, CAST(floor(({num(_W.north)} - s.lat - 0.012e0) / {num(_W.cell_y)}) AS BIGINT)),
    least({_W.rows}, CAST(ceil(({num(_W.north)} - s.lat + 0.012e0) / {num(_W.cell_y)}) AS BIGINT)))) AS row) r ON true
  JOIN LATERAL (SELECT unnest(range(greatest(0, CAST(floor((s.lon - {num(_W.west)} - 0.018e0) / {num(_W.cell_x)}) AS BIGINT)),
    least({_W.cols}, CAST(ceil((s.lon - {num(_W.west)} + 0.018e0) / {num(_W.cell_x)}) AS BIGINT)))) AS col) c ON true) x,
  LATERAL (SELECT CASE category WHEN 1 THEN [0, 0, 1, 2, 3] WHEN 2 THEN [0, 1, 2, 3, 4] WHEN 3 THEN [1, 2, 3, 4, 5] WHEN 4 THEN [2, 3, 4, 5, 6]
      WHEN 5 THEN [3, 4, 5, 6, 6] WHEN 6 THEN [4, 5, 6, NULL, NULL] WHEN 7 THEN [5, 6, 6, NULL, NULL] ELSE [6, 6, NULL, NULL, NULL] END[
      CASE WHEN dist_m <= 300 THEN 1 WHEN dist_m <= 500 THEN 2 WHEN dist_m <= 750 THEN 3 WHEN dist_m <= 1000 THEN 4 WHEN dist_m <= 1250 THEN 5 END] AS grade)
  WHERE dist_m <= [1250, 1250, 1250, 1000, 1000, 750, 500, 300][category] AND grade IS NOT NULL"""
C["op_grid"] = """SELECT feed_id, row, col, grade, dist_m, category FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, row, col
  ORDER BY grade, dist_m, category) AS rn FROM op_gridraw) WHERE rn = 1"""


def polygon(w: str, s: str, e: str, n: str) -> str:
    pt = lambda x, y: f"'[' || {fix6(x)} || ',' || {fix6(y)} || ']'"
    return (f"'{{\"type\":\"Polygon\",\"coordinates\":[[' || {pt(w, s)} || ',' || {pt(e, s)} || ',' || {pt(e, n)} || ',' || "
            f"{pt(w, n)} || ',' || {pt(w, s)} || ']]}}'")


def cell_box(west: float, north: float, cx: float, cy: float) -> str:
    w, n = f"({num(west)} + col * {num(cx)})", f"({num(north)} - row * {num(cy)})"
    return polygon(w, f"({n} - {num(cy)})", f"({w} + {num(cx)})", n)


C["op_gradechange"] = """SELECT coalesce(a.feed_a, b.feed_a) AS feed_a, coalesce(a.feed_b, b.feed_b) AS feed_b, coalesce(a.row, b.row) AS row,
  coalesce(a.col, b.col) AS col, coalesce(a.grade, -1) AS class_a, coalesce(b.grade, -1) AS class_b,
  CASE WHEN a.grade IS NULL THEN 'gained' WHEN b.grade IS NULL THEN 'lost' WHEN b.grade < a.grade THEN 'improved'
    WHEN b.grade > a.grade THEN 'degraded' ELSE 'unchanged' END AS change
  FROM (SELECT p.feed_a, p.feed_b, g.* FROM op_pairs p JOIN op_grid g ON g.feed_id = p.feed_a) a
  FULL JOIN (SELECT p.feed_a, p.feed_b, g.* FROM op_pairs p JOIN op_grid g ON g.feed_id = p.feed_b) b
  ON a.feed_a = b.feed_a AND a.feed_b = b.feed_b AND a.row = b.row AND a.col = b.col"""

# ---- population ----


def pop_grid(win) -> str:
    return f"""SELECT yr, CAST(px_row - {win.top} AS BIGINT) AS row, CAST(px_col - {win.left} AS BIGINT) AS col,
      CAST(sum(CAST(value * CASE WHEN yr = 2025 THEN 1e0 ELSE 0.01e0 END AS DECIMAL(28, 6))) AS DOUBLE) AS people FROM fx_pop_pixels
      WHERE px_col >= {win.left} AND px_col < {win.left + win.cols} AND px_row >= {win.top} AND px_row < {win.top + win.rows}
      GROUP BY 1, 2, 3"""


def pop_blocks(size: int) -> str:
    """People in blocks of ``size`` x ``size`` pixels, counted from the lattice's origin."""
    return f"""SELECT yr, CAST(floor(px_row / {size}e0) AS BIGINT) AS row, CAST(floor(px_col / {size}e0) AS BIGINT) AS col,
      sum(CAST(value * CASE WHEN yr = 2025 THEN 1e0 ELSE 0.01e0 END AS DECIMAL(28, 6))) AS people FROM fx_pop_pixels GROUP BY 1, 2, 3"""


def hectares(win) -> str:
    return (f"({num(win.cell_x * win.cell_y * 111320.0 * 111320.0 / 10000)} * cos(radians({num(win.north)} - (row + 0.5e0) * {num(win.cell_y)})))")


_V, _X = (window(-180.00041593133002, 89.09208317767579, box) for box in (POP_VIEW, POP_EXTENT))
C["op_popview"] = pop_grid(_V)
C["op_popextent"] = pop_grid(_X)
C["op_popscale"] = f"""SELECT *, CASE WHEN p_value > 0 THEN p_value ELSE top END AS scale FROM (SELECT yr, {p95('density')} AS p_value, max(density) AS top
  FROM (SELECT yr, people / {hectares(_X)} AS density FROM op_popextent WHERE people > 0) GROUP BY 1)"""
C["op_popdensity"] = f"""SELECT *, {step('norm', [0.2, 0.4, 0.6, 0.8])} AS class FROM (
  SELECT g.*, s.top, s.scale, greatest(0e0, least(1e0, density / CASE WHEN s.scale > 0 THEN s.scale ELSE 1e0 END)) AS norm
  FROM (SELECT *, people / {hectares(_V)} AS density FROM op_popview WHERE people > 0) g LEFT JOIN op_popscale s ON s.yr = g.yr)"""


def pop_year(y: str) -> str:
    return (f"CAST(CASE WHEN {y} <= 2000 THEN 2000 WHEN {y} <= 2021 THEN {y} WHEN abs(2025 - {y}) <= {y} - 2021 THEN 2025 ELSE 2021 END AS INTEGER)")


C["op_popyears"] = f"""SELECT p.feed_a, p.feed_b, {pop_year('a.year')} AS yr_a, {pop_year('b.year')} AS yr_b FROM op_pairs p
  JOIN op_years a ON a.feed_id = p.feed_a JOIN op_years b ON b.feed_id = p.feed_b"""
C["op_popcells"] = """SELECT *, people_b - people_a AS delta, CASE WHEN yr_a = yr_b THEN 'absolute' ELSE 'delta' END AS mode FROM (
  SELECT coalesce(a.feed_a, b.feed_a) AS feed_a, coalesce(a.feed_b, b.feed_b) AS feed_b, coalesce(a.yr_a, b.yr_a) AS yr_a,
    coalesce(a.yr_b, b.yr_b) AS yr_b, coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col,
    coalesce(a.people, 0e0) AS people_a, coalesce(b.people, 0e0) AS people_b
  FROM (SELECT y.*, g.row, g.col, g.people FROM op_popyears y JOIN op_popview g ON g.yr = y.yr_a) a
  FULL JOIN (SELECT y.*, g.row, g.col, g.people FROM op_popyears y JOIN op_popview g ON g.yr = y.yr_b) b
  ON a.feed_a = b.feed_a AND a.feed_b = b.feed_b AND a.row = b.row AND a.col = b.col)
  WHERE people_b - people_a <> 0 OR people_b > 0"""


def meets(box: tuple) -> str:
    w, s, e, n = box
    return f"max_lon >= {w} AND min_lon <= {e} AND max_lat >= {s} AND min_lat <= {n}"


# ---- inspector ----
C["op_dirs"] = """SELECT e.feed_a, e.feed_b, e.entry_id, e.side, e.raw_id AS route_id, d.*,
  CASE WHEN d.headsign <> '' THEN d.headsign ELSE d.last_stop END AS sign FROM op_entryroutes e
  JOIN op_directions d ON d.feed_id = e.feed_id AND d.route_id = e.raw_id"""
C["op_served"] = """SELECT DISTINCT feed_a, feed_b, entry_id, dir AS direction_id, side, stop_id AS raw_id FROM op_dirs WHERE dir <> -1"""
C["op_chosen"] = """SELECT d.*, m.canonical_id FROM op_dirs d JOIN (SELECT feed_a, feed_b, entry_id, dir, side, first(route_id ORDER BY n_stops DESC, route_id) AS route_id
  FROM op_dirs GROUP BY 1, 2, 3, 4, 5) b ON b.feed_a = d.feed_a AND b.feed_b = d.feed_b AND b.entry_id = d.entry_id AND b.dir = d.dir
    AND b.side = d.side AND b.route_id = d.route_id
  LEFT JOIN op_members m ON m.feed_id = d.feed_id AND m.raw_id = d.stop_id"""

# ---- geometry ----
C["op_lineshapes"] = """SELECT DISTINCT e.feed_a, e.feed_b, e.entry_id AS canonical_id, e.side, e.feed_id, s.shape_id,
  coalesce(d.direction_id, -1) AS dir FROM op_entryroutes e JOIN op_shaperoutes s ON s.feed_id = e.feed_id AND s.route_id = e.raw_id
  JOIN (SELECT DISTINCT feed_id, shape_id FROM op_points) p ON p.feed_id = s.feed_id AND p.shape_id = s.shape_id
  LEFT JOIN op_shapedir d ON d.feed_id = s.feed_id AND d.shape_id = s.shape_id"""
C["op_buckets"] = """SELECT *, len(dirs_a) >= 2 AND dirs_a = dirs_b AND NOT list_contains(dirs_a, -1) AS split,
  len(dirs_a) > 0 AND len(dirs_b) > 0 AS two_sided FROM (SELECT feed_a, feed_b, canonical_id,
  list_sort(coalesce(list(DISTINCT dir) FILTER (WHERE side = 'a'), [])) AS dirs_a,
  list_sort(coalesce(list(DISTINCT dir) FILTER (WHERE side = 'b'), [])) AS dirs_b FROM op_lineshapes GROUP BY 1, 2, 3)"""
KX = 111320.0 * math.cos(math.radians(47.5))
C["op_verts"] = f"""SELECT *, sum(coalesce(sqrt((x - p_x) * (x - p_x) + (y - p_y) * (y - p_y)), 0e0)) OVER (w ROWS UNBOUNDED PRECEDING) / 12.5e0 AS u
  FROM (SELECT *, lag(x) OVER w AS p_x, lag(y) OVER w AS p_y FROM (SELECT *, lon * {num(KX)} AS x, lat * 111132e0 AS y FROM (
    SELECT feed_id, shape_id, lon, lat, CAST(row_number() OVER (PARTITION BY feed_id, shape_id ORDER BY seq, lon, lat) - 1 AS INTEGER) AS i,
      lag(lon) OVER (PARTITION BY feed_id, shape_id ORDER BY seq, lon, lat) AS q_lon,
      lag(lat) OVER (PARTITION BY feed_id, shape_id ORDER BY seq, lon, lat) AS q_lat FROM op_points)
    WHERE q_lon IS NULL OR q_lon <> lon OR q_lat <> lat)
    WINDOW w AS (PARTITION BY feed_id, shape_id ORDER BY i))
  WINDOW w AS (PARTITION BY feed_id, shape_id ORDER BY i)"""
C["op_legs"] = """SELECT *, lead(lon) OVER w AS n_lon, lead(lat) OVER w AS n_lat, lead(x) OVER w AS n_x, lead(y) OVER w AS n_y, lead(u) OVER w AS n_u,
  max(u) OVER (PARTITION BY feed_id, shape_id) AS end_u FROM op_verts WINDOW w AS (PARTITION BY feed_id, shape_id ORDER BY i)"""
# The point one step behind (or ahead of) each vertex, found on the leg that holds that arc position.
C["op_tangents"] = """SELECT l.*, CASE WHEN n = 0 THEN 0e0 ELSE dx / n END AS ux, CASE WHEN n = 0 THEN 0e0 ELSE dy / n END AS uy FROM (
  SELECT v.*, f.x + (at_f - f.u) / (f.n_u - f.u) * (f.n_x - f.x) - (b.x + (at_b - b.u) / (b.n_u - b.u) * (b.n_x - b.x)) AS dx,
    f.y + (at_f - f.u) / (f.n_u - f.u) * (f.n_y - f.y) - (b.y + (at_b - b.u) / (b.n_u - b.u) * (b.n_y - b.y)) AS dy, sqrt(dx * dx + dy * dy) AS n
  FROM (SELECT *, greatest(0e0, u - 1) AS at_b, least(end_u, u + 1) AS at_f FROM op_legs WHERE n_u IS NOT NULL) v
  ASOF JOIN (SELECT * FROM op_legs WHERE n_u > u) b ON b.feed_id = v.feed_id AND b.shape_id = v.shape_id AND v.at_b >= b.u
  ASOF JOIN (SELECT * FROM op_legs WHERE n_u > u) f ON f.feed_id = v.feed_id AND f.shape_id = v.shape_id AND v.at_f > f.u) l"""
C["op_units"] = """SELECT s.feed_a, s.feed_b, s.canonical_id, CASE WHEN b.split THEN s.dir ELSE -9 END AS bucket, s.side, s.feed_id, s.shape_id
  FROM op_lineshapes s
  JOIN op_buckets b ON b.feed_a = s.feed_a AND b.feed_b = s.feed_b AND b.canonical_id = s.canonical_id AND b.two_sided"""
C["op_probes"] = f"""SELECT q.*, q.lon * {num(KX)} AS px, q.lat * 111132e0 AS py FROM (
  SELECT t.feed_id, t.shape_id, t.i, s.s, t.ux, t.uy, CASE WHEN s.s = t.n THEN t.n_lon ELSE t.lon + s.s * 1e0 / t.n * (t.n_lon - t.lon) END AS lon,
    CASE WHEN s.s = t.n THEN t.n_lat ELSE t.lat + s.s * 1e0 / t.n * (t.n_lat - t.lat) END AS lat
  FROM (SELECT *, greatest(1, CAST(ceil({hav('lat', 'lon', 'n_lat', 'n_lon')} / 12.5e0) AS BIGINT)) AS n FROM (SELECT * EXCLUDE (n) FROM op_tangents)) t,
    LATERAL (SELECT unnest(range(CASE WHEN t.i = 0 THEN 0 ELSE 1 END, t.n + 1)) AS s) s) q"""
LEN2 = "((o.n_x - o.x) * (o.n_x - o.x) + (o.n_y - o.y) * (o.n_y - o.y))"
TT = f"greatest(0e0, least(1e0, ((q.px - o.x) * (o.n_x - o.x) + (q.py - o.y) * (o.n_y - o.y)) / {LEN2}))"
D2 = f"(pow(q.px - (o.x + {TT} * (o.n_x - o.x)), 2) + pow(q.py - (o.y + {TT} * (o.n_y - o.y)), 2))"
C["op_inside"] = f"""SELECT u.feed_a, u.feed_b, u.canonical_id, u.bucket, u.side, u.shape_id AS gid, q.i, q.s, EXISTS (
    SELECT 1 FROM op_units w JOIN op_tangents o ON o.feed_id = w.feed_id AND o.shape_id = w.shape_id
    WHERE w.feed_a = u.feed_a AND w.feed_b = u.feed_b AND w.canonical_id = u.canonical_id AND w.bucket = u.bucket AND w.side <> u.side
      AND {D2} <= 625 AND ({D2} <= 25 OR abs(o.ux * q.ux + o.uy * q.uy) >= {num(math.cos(math.pi / 4))})) AS inside
  FROM op_units u JOIN op_probes q ON q.feed_id = u.feed_id AND q.shape_id = u.shape_id"""

Q: dict[str, str] = {
    "typed_stops": "SELECT * FROM op_stops",
    "typed_routes": "SELECT * FROM op_routes",
    "route_modes": "SELECT feed_id, route_type, mode, count(*) AS routes FROM op_routes GROUP BY 1, 2, 3",
    "stop_modes": "SELECT feed_id, stop_id, stop_name, lat, lon, array_to_string(modes, ',') AS modes, primary_mode FROM op_stopmodes",
    "shape_modes": "SELECT feed_id, shape_id, coords, array_to_string(modes, ',') AS modes, primary_mode, coalesce(route_id, '') AS route_id FROM op_shapemodes",
    "lines_for_stop": f"SELECT *, {rank('mode')} AS mode_rank, {natural('coalesce(nullif(short_name, $$$$), long_name)')} AS name_key FROM op_lines",
    "route_metas": f"""SELECT r.*, coalesce(t.n, 0) AS trip_count, {rank('r.mode')} AS mode_rank,
      {natural("coalesce(nullif(r.short_name, ''), r.long_name)")} AS name_key FROM (SELECT feed_id, route_id, coalesce(short_name, '') AS short_name,
      coalesce(long_name, '') AS long_name, coalesce(agency_name, '') AS agency_name, route_type, mode FROM op_routes) r
      LEFT JOIN (SELECT feed_id, route_id, count(*) AS n FROM fx_trips GROUP BY 1, 2) t ON t.feed_id = r.feed_id AND t.route_id = r.route_id""",
    "route_weekly_trips": "SELECT * FROM op_weekly",
    "feed_weekly_trips": "SELECT * FROM op_feedweekly",
    "stop_departures": "SELECT * FROM op_departures",
    "dep_minutes": f"SELECT feed_id, departure_time, count(*) AS calls, {MIN_OF.format('departure_time')} AS minutes FROM fx_stop_times GROUP BY 1, 2",
    "route_shapes": """SELECT t.feed_id, t.route_id, t.shape_id, count(*) AS points FROM (SELECT DISTINCT feed_id, route_id, shape_id FROM fx_trips) t
      JOIN op_points p ON p.feed_id = t.feed_id AND p.shape_id = t.shape_id GROUP BY 1, 2, 3""",
    "trip_patterns": "SELECT * FROM op_patterns",
    "pattern_groups": "SELECT feed_id, route_id, dir, trip_count, stop_count, sample_trip_id, headsign FROM op_patterngroups",
    "route_directions": """SELECT feed_id, route_id, CASE WHEN dir <> -1 THEN dir END AS direction_id,
      CASE WHEN headsign <> '' THEN headsign ELSE last_stop END AS headsign, trip_count, pos, seq, stop_id, stop_name, lat, lon, n_stops FROM op_directions""",
    "shape_routes": "SELECT * FROM op_shaperoutes",
    "shape_owner": "SELECT feed_id, shape_id, route_id FROM op_shaperoutes WHERE rank = 1",
    "shape_direction": "SELECT * FROM op_shapedir",
    "clicked_shape_routes": """SELECT feed_id, route_id, pos, rank FROM (SELECT r.feed_id, r.route_id, p.pos, r.rank,
      row_number() OVER (PARTITION BY r.feed_id, r.route_id ORDER BY p.pos, r.rank) AS rn FROM op_shaperoutes r
      JOIN (SELECT feed_id, shape_id, min(trip_id) AS pos FROM fx_trips WHERE shape_id IS NOT NULL GROUP BY 1, 2) p
      ON p.feed_id = r.feed_id AND p.shape_id = r.shape_id) WHERE rn = 1""",
    "shape_lengths": f"SELECT feed_id, shape_id, {half('length_m', 3)} AS length_m, points FROM op_lengths",
    "feed_bounds": """SELECT f.feed_id, s.*  EXCLUDE (feed_id), p.* EXCLUDE (feed_id) FROM fx_feeds f
      LEFT JOIN (SELECT feed_id, min(lon) AS stops_west, min(lat) AS stops_south, max(lon) AS stops_east, max(lat) AS stops_north FROM op_stops GROUP BY 1) s ON s.feed_id = f.feed_id
      LEFT JOIN (SELECT feed_id, min(lon) AS shapes_west, min(lat) AS shapes_south, max(lon) AS shapes_east, max(lat) AS shapes_north FROM op_points GROUP BY 1) p ON p.feed_id = f.feed_id""",
    "feed_capabilities": "SELECT * FROM op_caps",
    "feed_counts": "SELECT * FROM op_counts",
    "feed_dates": "SELECT * FROM op_dates",
    "feed_label": "SELECT * FROM op_labels",
    "feed_catalog": """SELECT f.*, l.label, c.stop_count, c.route_count, c.trip_count, d.start_date, d.end_date FROM fx_feeds f
      JOIN op_labels l ON l.feed_id = f.feed_id JOIN op_counts c ON c.feed_id = f.feed_id JOIN op_dates d ON d.feed_id = f.feed_id""",
    "feed_completeness": """SELECT feed_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS complete FROM (SELECT feed_id,
      list_filter(['stops', 'routes', 'trips'], lambda x: NOT list_contains(list(stem), x)) AS missing FROM fx_files GROUP BY 1)""",
    "stale_schema": "SELECT feed_id FROM fx_files WHERE stem = 'stop_times' AND cols NOT LIKE '%departure_time%'",
    "norm_stop_name": f"SELECT stop_name, {norm_stop('stop_name')} AS name_key FROM (SELECT DISTINCT stop_name FROM fx_stops)",
    "norm_route_short": f"SELECT route_short_name, {norm_short('route_short_name')} AS short_key FROM (SELECT DISTINCT route_short_name FROM fx_routes)",
    "norm_loose": f"""SELECT name, {norm_loose('name')} AS loose_key FROM (SELECT route_long_name AS name FROM fx_routes
      UNION SELECT agency_name FROM fx_agency)""",
    "stop_spatial_scopes": """SELECT k.key, h.key AS scope_head, s.members FROM op_keys k JOIN op_scope s ON s.n = k.n
      JOIN op_keys h ON h.n = s.scope""",
    "stop_rawid_components": """, op_rawreach AS (SELECT a AS n, a AS m FROM op_raw UNION SELECT r.n, e.b FROM op_rawreach r JOIN op_raw e ON e.a = r.m)
      SELECT k.key, min(h.key) AS head FROM op_rawreach r JOIN op_keys k ON k.n = r.n JOIN op_keys h ON h.n = r.m GROUP BY 1""",
    "stop_assignments": "SELECT feed_id, raw_id, canonical_id FROM op_members",
    "canonical_stops": f"SELECT canonical_id, name, name_key, {half('lat', 6)} AS lat, {half('lon', 6)} AS lon, member_count, feed_count FROM op_canonstops",
    "route_assignments": "SELECT feed_id, raw_id, canonical_id FROM op_rmembers",
    "canonical_routes": "SELECT * FROM op_canonroutes",
    "overridden_assignments": """SELECT 'stop' AS kind, feed_id, raw_id, final_id AS canonical_id FROM op_stopovfinal
      UNION ALL SELECT 'route', feed_id, raw_id, final_id FROM op_routeovfinal""",
    "overridden_canonicals": "SELECT 'stop' AS kind, * FROM op_stopovcanon UNION ALL SELECT 'route', * FROM op_routeovcanon",
    "truth_parse": "SELECT * FROM fx_truth",
    "match_quality": f"""SELECT kind, tp, fp, tn, fn, unknown, total, {half('pr', 6)} AS precision, {half('rc', 6)} AS recall,
      {half('CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END', 6)} AS f1, {half('CASE WHEN total = 0 THEN 0 ELSE (tp + tn) / total END', 6)} AS accuracy
      FROM (SELECT *, tp + fp + tn + fn AS total, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS pr,
        CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS rc FROM (SELECT kind, count(*) FILTER (WHERE predicted AND same) AS tp,
        count(*) FILTER (WHERE predicted AND NOT same) AS fp, count(*) FILTER (WHERE NOT predicted AND NOT same) AS tn,
        count(*) FILTER (WHERE NOT predicted AND same) AS fn, count(*) FILTER (WHERE predicted IS NULL) AS unknown FROM op_judged GROUP BY 1))""",
    "match_mistakes": "SELECT * FROM op_judged WHERE predicted <> same",
    "registry_browse": """SELECT canonical_id, name, member_count, feed_count FROM op_canonstops WHERE feed_count >= 2 AND
      (contains(lower(name), 'platz') OR contains(lower(canonical_id), 'platz')) ORDER BY feed_count DESC, member_count DESC, name, canonical_id""",
    "registry_stale": """SELECT feed_id, 'unloaded' AS change FROM (SELECT DISTINCT feed_id FROM op_stops) WHERE feed_id NOT IN (
      SELECT feed_id FROM fx_feeds WHERE source_name NOT LIKE 'asia%')""",
    "stop_diff": f"""SELECT feed_a, feed_b, canonical_id, status, label, moved, renamed, {half('dist_m', 3)} AS dist_m, a_name, {half('a_lat', 6)} AS a_lat,
      {half('a_lon', 6)} AS a_lon, a_raw_count, b_name, {half('b_lat', 6)} AS b_lat, {half('b_lon', 6)} AS b_lon, b_raw_count FROM op_stopdiff""",
    "route_diff": "SELECT * FROM op_routediff",
    "diff_summary": """SELECT *, CAST(sum(entries) OVER (PARTITION BY feed_a, feed_b, kind) AS BIGINT) AS total,
      CAST(sum(CASE WHEN status <> 'unchanged' THEN entries ELSE 0 END) OVER (PARTITION BY feed_a, feed_b, kind) AS BIGINT) AS changed FROM op_statuses""",
    "step_diffs": """SELECT x.*, CAST(sum(entries) OVER (PARTITION BY x.feed_a, x.feed_b, kind) AS BIGINT) AS total,
      CAST(sum(CASE WHEN status <> 'unchanged' THEN entries ELSE 0 END) OVER (PARTITION BY x.feed_a, x.feed_b, kind) AS BIGINT) AS changed
      FROM op_statuses x JOIN op_steps s ON s.feed_a = x.feed_a AND s.feed_b = x.feed_b""",
    "auto_pair": "SELECT * FROM op_auto WHERE feed_a <> feed_b",
    "raw_status": "SELECT *, 'stop' AS kind FROM op_entrystops UNION ALL SELECT *, 'route' FROM op_entryroutes",
    "stop_diff_points": f"""SELECT feed_a, feed_b, canonical_id, status, a_name, b_name, {half('dist_m')} AS dist_m,
      {half('coalesce(b_lon, a_lon)', 6)} AS lon, {half('coalesce(b_lat, a_lat)', 6)} AS lat FROM op_stopdiff""",
    "stop_diff_for_feed": f"""SELECT feed_a, feed_b, canonical_id, status, a_name, b_name, {half('dist_m')} AS dist_m, 'a' AS side, {half('a_lon', 6)} AS lon,
      {half('a_lat', 6)} AS lat FROM op_stopdiff WHERE a_name IS NOT NULL UNION ALL SELECT feed_a, feed_b, canonical_id, status, a_name, b_name,
      {half('dist_m')}, 'b', {half('b_lon', 6)}, {half('b_lat', 6)} FROM op_stopdiff WHERE b_name IS NOT NULL""",
    "stop_ghosts": f"SELECT feed_a, feed_b, canonical_id, 'moved-from' AS status, {half('a_lon', 6)} AS lon, {half('a_lat', 6)} AS lat FROM op_stopdiff WHERE status = 'moved'",
    "move_arrows": f"""SELECT feed_a, feed_b, canonical_id, {half('dist_m')} AS dist_m, '{{"type":"LineString","coordinates":[[' || {fix6('a_lon')} || ',' ||
      {fix6('a_lat')} || '],[' || {fix6('b_lon')} || ',' || {fix6('b_lat')} || ']]}}' AS geometry FROM op_stopdiff WHERE status = 'moved'""",
    "line_search": """SELECT feed_a, feed_b, canonical_id, short_name, long_name, mode, status, CASE WHEN regexp_matches(short_name, '^[0-9]') THEN '0' ELSE '1' END || """
                   + natural("short_name") + """ AS sort_key FROM (SELECT feed_a, feed_b, canonical_id, coalesce(b_short_name, a_short_name) AS short_name,
      coalesce(b_long_name, a_long_name) AS long_name, coalesce(b_mode, a_mode) AS mode, CASE WHEN status IN ('added', 'removed') THEN status ELSE 'unchanged' END AS status
      FROM op_routediff) WHERE status = 'unchanged' AND contains(lower(short_name || ' ' || long_name), 'linie 1')""",
    "feed_frequency": f"SELECT feed_id, route_id, trips_per_week, max_weekly, scale_weekly, {half('trips_norm', 6)} AS trips_norm, class FROM op_feedfreq",
    "freq_scale": "SELECT * FROM op_freqscale",
    "freq_classes": "SELECT feed_id, class, count(*) AS routes FROM op_feedfreq GROUP BY 1, 2",
    "freq_diff": scaled("SELECT * FROM op_freqdiff"),
    "freq_diff_matched": scaled("SELECT * FROM op_freqdiff WHERE status NOT IN ('added', 'removed')"),
    "feed_years": """SELECT * REPLACE (CAST(rep_date AS VARCHAR) AS rep_date, CAST(span_start AS VARCHAR) AS span_start, CAST(span_end AS VARCHAR) AS span_end) FROM op_years""",
    "feed_year_labels": "SELECT * FROM op_yearlabels",
    "year_range": "SELECT lo, hi, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS year FROM (SELECT min(year) AS lo, max(year) AS hi FROM op_years)",
    "feed_for_year": """SELECT y.year, coalesce(
        (SELECT first(f.feed_id ORDER BY f.loaded_at DESC, f.feed_id DESC) FROM op_years f WHERE f.year = y.year),
        (SELECT first(f.feed_id ORDER BY abs(f.year - y.year), f.year DESC, f.rep_ms, f.feed_id) FROM op_years f)) AS feed_id
      FROM (SELECT CAST(unnest(range((SELECT min(year) FROM op_years), (SELECT max(year) + 1 FROM op_years))) AS INTEGER) AS year) y""",
    "feeds_between": """SELECT p.feed_a, p.feed_b, f.feed_id, f.year, f.rep_ms FROM (SELECT * FROM op_pairs UNION ALL SELECT feed_b, feed_a FROM op_steps) p
      JOIN op_years a ON a.feed_id = p.feed_a JOIN op_years b ON b.feed_id = p.feed_b
      JOIN op_years f ON (f.rep_ms, f.feed_id) >= least((a.rep_ms, a.feed_id), (b.rep_ms, b.feed_id)) AND (f.rep_ms, f.feed_id) <= greatest((a.rep_ms, a.feed_id), (b.rep_ms, b.feed_id))""",
    "feed_steps": "SELECT * FROM op_steps",
    "timeline_trend": "SELECT * FROM op_trend",
    "trend_since_baseline": """SELECT t.feed_id, t.year, t.stops - b.stops AS stops, t.routes - b.routes AS routes, t.trips - b.trips AS trips,
      t.weekly_trips - b.weekly_trips AS weekly_trips FROM op_trend t, (SELECT * FROM op_trend WHERE feed_id = (SELECT feed_a FROM op_auto)) b""",
    "cumulative_stops": "SELECT * FROM op_churn",
    "timeline_summary": "SELECT * FROM op_change",
    "timeline_narrative": """SELECT feed_a, feed_b, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos, unnest(lines) AS sentence FROM (
      SELECT feed_a, feed_b, CASE WHEN len(l) = 0 THEN ['No changes detected since baseline.'] ELSE l END AS lines FROM (SELECT feed_a, feed_b, list_filter([
        CASE WHEN stops_added > 0 OR stops_removed > 0 THEN stops_added || ' stops added, ' || stops_removed || ' removed since baseline' ||
          CASE WHEN net_stops_added <> stops_added OR net_stops_removed <> stops_removed THEN ' (' || net_stops_added || ' net added, ' || net_stops_removed || ' net removed).' ELSE '.' END END,
        CASE WHEN stops_moved > 0 OR stops_renamed > 0 THEN stops_moved || ' stops relocated, ' || stops_renamed || ' renamed.' END,
        CASE WHEN routes_added > 0 OR routes_removed > 0 OR routes_renumbered > 0 THEN routes_added || ' new routes, ' || routes_removed || ' discontinued, ' || routes_renumbered || ' renumbered.' END,
        CASE WHEN freq_gain > 0 OR freq_loss > 0 THEN freq_gain || ' routes gained frequency, ' || freq_loss || ' lost service.' END,
        CASE WHEN trip_delta <> 0 THEN abs(trip_delta) || CASE WHEN trip_delta >= 0 THEN ' more' ELSE ' fewer' END || ' scheduled trips overall.' END,
        CASE WHEN span_start_a <> span_start_b OR span_end_a <> span_end_b THEN 'Service window: ' || span_start_a || ' → ' || span_end_a || ' to ' || span_start_b || ' → ' || span_end_b || '.' END
      ], lambda x: x IS NOT NULL) AS l FROM op_change))""",
    "entity_history": f"""SELECT canonical_id, count(*) AS present, count(DISTINCT name) AS names, count(DISTINCT place) AS places, (SELECT count(*) FROM fx_feeds) AS feeds_total
      FROM (SELECT canonical_id, feed_id, first(name ORDER BY raw_id DESC) AS name, first(({half('lat', 5)}, {half('lon', 5)}) ORDER BY raw_id DESC) AS place FROM op_members GROUP BY 1, 2) GROUP BY 1""",
    "entity_history_rows": """SELECT m.canonical_id, y.feed_id, y.year, true AS present, m.name, m.lat, m.lon FROM op_years y
      JOIN (SELECT *, row_number() OVER (PARTITION BY canonical_id, feed_id ORDER BY raw_id DESC) AS rn FROM op_members) m ON m.feed_id = y.feed_id AND m.rn = 1""",
    "stop_categories": f"""SELECT feed_id, stop_id, stop_name, lat, lon, departures, {half('interval_min', 6)} AS interval_min, interval_class, mode_category, category FROM op_ranked""",
    "grade_grid": f"SELECT feed_id, row, col, grade, {half('dist_m', 3)} AS dist_m, category FROM op_grid",
    "grade_cells": f"""SELECT feed_id, row, col, grade AS class, ['A', 'B', 'C', 'D', 'E', 'F', 'G'][grade + 1] AS class_letter,
      ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII'][category] AS category, {half('dist_m')} AS distance_m, {cell_box(_W.west, _W.north, _W.cell_x, _W.cell_y)} AS geometry FROM op_grid""",
    "grade_summary": f"""SELECT n.feed_id, n.stop_count, {', '.join(f"coalesce(g.cells_{x}, 0) AS cells_{x}" for x in 'ABCDEFG')}, coalesce(g.covered, 0) AS covered,
      {_W.cols * _W.rows} AS cell_count, {_W.cols * _W.rows} - coalesce(g.covered, 0) AS no_coverage FROM (SELECT feed_id, count(*) AS stop_count FROM op_ranked GROUP BY 1) n
      LEFT JOIN (SELECT feed_id, {', '.join(f"count(*) FILTER (WHERE grade = {i}) AS cells_{x}" for i, x in enumerate('ABCDEFG'))}, count(*) AS covered FROM op_grid GROUP BY 1) g ON g.feed_id = n.feed_id""",
    "grade_change": f"SELECT *, {cell_box(_W.west, _W.north, _W.cell_x, _W.cell_y)} AS geometry FROM op_gradechange",
    "grade_change_summary": f"""SELECT feed_a, feed_b, {', '.join(f"count(*) FILTER (WHERE change = '{n}') AS {n}" for n in ['improved', 'degraded', 'unchanged', 'gained', 'lost'])},
      count(*) AS cell_count FROM op_gradechange GROUP BY 1, 2""",
    "pop_pixels": f"SELECT yr, count(*) AS pixels, {half('sum(value * CASE WHEN yr = 2025 THEN 1e0 ELSE 0.01e0 END)', 2)} AS people FROM fx_pop_pixels GROUP BY 1",
    "pop_year": f"SELECT feed_id, year, {pop_year('year')} AS pop_year FROM op_years",
    "pop_pyramid": f"SELECT yr, row, col, {half('people', 2)} AS people FROM op_popextent",
    "pop_grid": f"SELECT yr, row, col, {half('people', 2)} AS people FROM op_popview",
    "pop_grid_level": f"""SELECT yr, row - {_V.top // 8} AS row, col - {_V.left // 8} AS col, {half('CAST(people AS DOUBLE)', 2)} AS people
      FROM ({pop_blocks(8)}) WHERE row BETWEEN {_V.top // 8} AND {(_V.top + _V.rows - 1) // 8}
      AND col BETWEEN {_V.left // 8} AND {(_V.left + _V.cols - 1) // 8}""",
    "pop_levels": " UNION ALL ".join(f"""SELECT {x} AS level, yr, count(*) AS cells, {half('CAST(sum(people) AS DOUBLE)', 2)} AS people,
      {half('CAST(max(people) AS DOUBLE)', 2)} AS top FROM ({pop_blocks(x)}) GROUP BY yr""" for x in (1, 2, 4, 8)),
    "pop_density": f"""SELECT yr, row, col, {half('people', 2)} AS people, {half('density', 4)} AS density, {half('norm', 4)} AS norm, class,
      {cell_box(_V.west, _V.north, _V.cell_x, _V.cell_y)} AS geometry FROM op_popdensity""",
    "pop_scale": f"SELECT yr, {half('p_value', 4)} AS p_value, {half('top', 4)} AS top, {half('scale', 4)} AS scale FROM op_popscale",
    "pop_classes": "SELECT yr, class, count(*) AS cells FROM op_popdensity GROUP BY 1, 2",
    "pop_summary": f"""SELECT yr, count(*) AS cell_count, {half('max(top)', 4)} AS max_density, {half('max(scale)', 4)} AS scale_density,
      {math.floor(_V.cell_y * 111320.0 + 0.5)} AS cell_m FROM op_popdensity GROUP BY 1""",
    "pop_delta": f"""SELECT feed_a, feed_b, yr_a, yr_b, row, col, {half('people_a', 2)} AS people_a, {half('people_b', 2)} AS people_b, mode, {half('delta', 2)} AS delta,
      {half(f'people_b / {hectares(_V)}', 4)} AS density_b, {half('norm', 4)} AS norm, {step('norm', [0.2, 0.4, 0.6, 0.8])} AS class, {half(f'people_a / {hectares(_V)}', 4)} AS density_a,
      CASE WHEN mode = 'delta' THEN {half(f'delta / {hectares(_V)}', 4)} END AS delta_ha, CASE WHEN mode = 'delta' THEN {step(f'delta / {hectares(_V)}', [-25, -10, 10, 25])} END AS delta_class
      FROM (SELECT c.*, greatest(0e0, least(1e0, c.people_b / {hectares(_V)} / CASE WHEN s.scale > 0 THEN s.scale ELSE 1e0 END)) AS norm FROM op_popcells c LEFT JOIN op_popscale s ON s.yr = c.yr_b)""",
    "district_bbox": f"SELECT * FROM fx_districts WHERE {meets(POP_VIEW)}",
    "district_population": f"""SELECT g_id, g_name, geometry, population, scale, {half('norm', 6)} AS norm, {step('norm', [0.2, 0.4, 0.6, 0.8])} AS class, 2026 AS year FROM (
      SELECT d.*, CAST(p.population AS DOUBLE) AS population, s.scale, greatest(0e0, least(1e0, p.population / CASE WHEN s.scale > 0 THEN s.scale * 1e0 ELSE 1e0 END)) AS norm FROM fx_districts d
      JOIN fx_district_pop p ON p.g_id = d.g_id, (SELECT CASE WHEN {p95('p.population')} > 0 THEN {p95('p.population')} ELSE max(p.population) END AS scale
        FROM fx_districts d JOIN fx_district_pop p ON p.g_id = d.g_id WHERE {meets(POP_EXTENT)} AND p.population > 0) s WHERE {meets(POP_VIEW)} AND p.population > 0)""",
    "diff_lines_for_stop": f"""SELECT *, {rank('mode')} AS mode_rank, {natural("coalesce(nullif(short_name, ''), long_name)")} AS name_key FROM (
      SELECT p.feed_a, p.feed_b, m.canonical_id AS stop_canonical_id, e.entry_id AS line_id, {longest('l.short_name')} AS short_name, {longest('l.long_name')} AS long_name,
        {longest('l.agency_name')} AS agency, min(l.mode) AS mode, min(e.status) AS status, max(CASE WHEN e.side = 'a' THEN l.route_id END) AS a_raw_id,
        max(CASE WHEN e.side = 'b' THEN l.route_id END) AS b_raw_id, CAST(coalesce(sum(CASE WHEN e.side = 'a' THEN l.trip_count END), 0) AS BIGINT) AS a_trips,
        CAST(coalesce(sum(CASE WHEN e.side = 'b' THEN l.trip_count END), 0) AS BIGINT) AS b_trips
      FROM op_pairs p JOIN op_lines l ON l.feed_id IN (p.feed_a, p.feed_b) JOIN op_members m ON m.feed_id = l.feed_id AND m.raw_id = l.stop_id
      JOIN op_entryroutes e ON e.feed_a = p.feed_a AND e.feed_b = p.feed_b AND e.feed_id = l.feed_id AND e.raw_id = l.route_id GROUP BY 1, 2, 3, 4)""",
    "diff_route_stops": """SELECT c.feed_a, c.feed_b, c.entry_id, c.dir, c.side, c.pos, c.stop_id, c.stop_name, c.canonical_id, d.status AS stop_status, c.sign AS headsign, c.trip_count,
      CASE WHEN EXISTS (SELECT 1 FROM op_chosen o WHERE o.feed_a = c.feed_a AND o.feed_b = c.feed_b AND o.entry_id = c.entry_id AND o.dir = c.dir AND o.side <> c.side
        AND o.canonical_id = c.canonical_id) THEN 'match' ELSE 'only-here' END AS role FROM op_chosen c
      LEFT JOIN op_stopdiff d ON d.feed_a = c.feed_a AND d.feed_b = c.feed_b AND d.canonical_id = c.canonical_id""",
    "line_directions": """SELECT feed_a, feed_b, entry_id, dir AS direction_id, coalesce(first(sign ORDER BY route_id DESC) FILTER (WHERE side = 'b' AND sign <> ''),
        first(sign ORDER BY route_id DESC) FILTER (WHERE side = 'a' AND sign <> '')) AS headsign, count(DISTINCT CASE WHEN side = 'a' THEN stop_id END) AS stops_a,
      count(DISTINCT CASE WHEN side = 'b' THEN stop_id END) AS stops_b FROM op_dirs WHERE dir <> -1 GROUP BY 1, 2, 3, 4""",
    "stops_on_route": """SELECT DISTINCT d.feed_a, d.feed_b, d.canonical_id, d.status FROM op_stopdiff d
      JOIN op_entrystops e ON e.feed_a = d.feed_a AND e.feed_b = d.feed_b AND e.entry_id = d.canonical_id
      WHERE NOT EXISTS (SELECT 1 FROM op_served s WHERE s.entry_id LIKE '%_tram_%' AND s.direction_id = 0 AND s.feed_a = d.feed_a AND s.feed_b = d.feed_b) OR EXISTS (SELECT 1 FROM op_served s
        WHERE s.entry_id LIKE '%_tram_%' AND s.direction_id = 0 AND s.feed_a = e.feed_a AND s.feed_b = e.feed_b AND s.side = e.side AND s.raw_id = e.raw_id)""",
    "route_pairs": "SELECT feed_a, feed_b, entry_id AS canonical_id, side, feed_id, raw_id AS route_id FROM op_entryroutes",
    "direction_buckets": "SELECT feed_a, feed_b, canonical_id, array_to_string(dirs_a, ',') AS dirs_a, array_to_string(dirs_b, ',') AS dirs_b, split, two_sided FROM op_buckets",
    "shape_tangents": f"SELECT feed_id, shape_id, i, lon, lat, {half('ux', 6)} AS ux, {half('uy', 6)} AS uy FROM op_tangents",
    "geom_samples": """SELECT feed_a, feed_b, canonical_id, bucket, side, gid, count(*) AS samples, count(*) FILTER (WHERE inside) AS inside,
      CAST(sum(CASE WHEN inside THEN i * 1000 + s ELSE 0 END) AS BIGINT) AS where_inside FROM op_inside GROUP BY 1, 2, 3, 4, 5, 6""",
    "route_km_delta": f"""SELECT e.feed_a, e.feed_b, {half("coalesce(sum(CASE WHEN e.status = 'added' THEN l.km END), 0e0)", 3)} AS added_km,
      {half("coalesce(sum(CASE WHEN e.status = 'removed' THEN l.km END), 0e0)", 3)} AS removed_km FROM op_entryroutes e LEFT JOIN (
        SELECT t.feed_id, t.route_id, max(p.length_m) / 1000 AS km FROM (SELECT DISTINCT feed_id, route_id, shape_id FROM fx_trips) t
        JOIN op_lengths p ON p.feed_id = t.feed_id AND p.shape_id = t.shape_id GROUP BY 1, 2) l ON l.feed_id = e.feed_id AND l.route_id = e.raw_id
      WHERE e.status IN ('added', 'removed') GROUP BY 1, 2""",
}


def js(*fields: tuple[str, str]) -> str:
    """JSON object text from (key, string expression) pairs, leaving null values out."""
    parts = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '\"{k}\":\"' || ({v}) || '\"' END" for k, v in fields)
    return f"('{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}')"


def code(m: str) -> str:
    return f"(CASE {m} WHEN 'tram' THEN '0' WHEN 'metro' THEN '1' WHEN 'rail' THEN '2' WHEN 'bus' THEN '3' WHEN 'other' THEN '3' END)"


def stop_row(x: str) -> str:
    return js(("stop_id", "e.raw_id"), ("stop_name", f"d.{x}_name"), ("stop_lat", fix6(f"d.{x}_lat")), ("stop_lon", fix6(f"d.{x}_lon")))


def stop_delta(x: str) -> str:
    return js(("stop_lat", f"CASE WHEN d.moved THEN {fix6(f'd.{x}_lat')} END"), ("stop_lon", f"CASE WHEN d.moved THEN {fix6(f'd.{x}_lon')} END"),
              ("stop_name", f"CASE WHEN d.renamed THEN d.{x}_name END"))


def route_row(x: str) -> str:
    return js(("route_id", "e.raw_id"), ("route_short_name", f"d.{x}_short_name"), ("route_long_name", f"d.{x}_long_name"),
              ("agency_id", f"d.{x}_agency_name"), ("route_type", code(f"d.{x}_mode")))


def route_delta(x: str) -> str:
    return js(("route_long_name", f"CASE WHEN d.a_long_name <> d.b_long_name THEN d.{x}_long_name END"),
              ("agency_id", f"CASE WHEN d.a_agency_name <> d.b_agency_name THEN d.{x}_agency_name END"))


BOTH = "d.status IN ('moved', 'renamed')"
MOD = "d.status = 'modified'"
Q["gtfs_diff_export"] = f"""SELECT feed_a, feed_b, row_number() OVER (PARTITION BY feed_a, feed_b ORDER BY file = 'routes.txt', entry_id, action, raw_id) AS id, file, action, 'row' AS target,
  identifier, initial_value, new_value, note FROM (SELECT * FROM (
  SELECT e.feed_a, e.feed_b, 'stops.txt' AS file, CASE WHEN {BOTH} THEN 'update' WHEN e.side = 'a' THEN 'delete' ELSE 'add' END AS action,
    CASE WHEN e.side = 'a' THEN {js(("stop_id", "e.raw_id"))} END AS identifier, CASE WHEN {BOTH} THEN {stop_delta('a')} WHEN e.side = 'a' THEN {stop_row('a')} END AS initial_value,
    CASE WHEN {BOTH} THEN {stop_delta('b')} WHEN e.side = 'b' THEN {stop_row('b')} END AS new_value, '' AS note, e.entry_id, e.raw_id
  FROM op_entrystops e JOIN op_stopdiff d ON d.feed_a = e.feed_a AND d.feed_b = e.feed_b AND d.canonical_id = e.entry_id
  WHERE d.status <> 'unchanged' AND (NOT {BOTH} OR e.side = 'a')
  UNION ALL SELECT e.feed_a, e.feed_b, 'routes.txt', CASE WHEN {MOD} THEN 'update' WHEN e.side = 'a' THEN 'delete' ELSE 'add' END,
    CASE WHEN e.side = 'a' THEN {js(("route_id", "e.raw_id"))} END, CASE WHEN {MOD} THEN {route_delta('a')} WHEN e.side = 'a' THEN {route_row('a')} END,
    CASE WHEN {MOD} THEN {route_delta('b')} WHEN e.side = 'b' THEN {route_row('b')} END, CASE WHEN d.status = 'renumbered' THEN 'renumbered' ELSE '' END, e.entry_id, e.raw_id
  FROM op_entryroutes e JOIN op_routediff d ON d.feed_a = e.feed_a AND d.feed_b = e.feed_b AND d.canonical_id = e.entry_id
  WHERE d.status <> 'unchanged' AND (NOT {MOD} OR (e.side = 'a' AND (d.a_long_name <> d.b_long_name OR d.a_agency_name <> d.b_agency_name)))))"""


def flags_json() -> str:
    shown = "CASE WHEN len(modes) = 0 THEN ['other'] ELSE modes END"
    return " || ',' || ".join(f"'\"is_{m}\":' || CASE WHEN list_contains({shown}, '{m}') THEN 'true' ELSE 'false' END" for m in MODES)


Q["stops_geojson"] = f"""SELECT feed_id, stop_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {fix6('lon')} || ',' || {fix6('lat')} || ']}},"properties":{{"stop_id":"' ||
  stop_id || '","stop_name":"' || stop_name || '","primary_mode":"' || primary_mode || '",' || {flags_json()} || '}}}}' AS feature FROM op_stopmodes"""
Q["shapes_geojson"] = f"""SELECT feed_id, shape_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":' || coords || '}},"properties":{{"shape_id":"' ||
  shape_id || '","primary_mode":"' || primary_mode || '",' || {flags_json()} || '}}}}' AS feature FROM op_shapemodes"""
Q["ingest_tables"] = " UNION ALL ".join(
    f"SELECT f.source_name, '{s}' AS stem, count(*) AS rows FROM fx_{s} t JOIN fx_feeds f ON f.feed_id = t.feed_id GROUP BY 1"
    for s in ["agency", "stops", "routes", "trips", "stop_times", "calendar", "shapes", "feed_info"])


def _digest(table: str, stem: str, columns: list[str]) -> str:
    line = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"""SELECT feed_id, '{stem}' AS stem, count(*) AS rows,
      CAST(sum(CAST('0x' || substr(md5({line}), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM {table} GROUP BY 1"""


_HEADSIGN = """CASE WHEN trip_headsign = '' THEN '' ELSE trip_headsign || chr(10) || '"' || trip_id || '",' || chr(10) || 'via' END"""
_SCANNED = " UNION ALL ".join(
    _digest("(SELECT * REPLACE (" + _HEADSIGN + " AS trip_headsign) FROM fx_trips)" if s == "trips" else f"fx_{s}", s, columns)
    for s, columns in STEM_COLUMNS.items())
Q["csv_scan"] = f"""SELECT f.source_name, d.stem, d.rows, d.digest FROM ({_SCANNED}) d JOIN fx_feeds f ON f.feed_id = d.feed_id"""
Q["parquet_roundtrip"] = " UNION ALL ".join(_digest(f"fx_{s}", s, c) for s, c in [
    *STEM_COLUMNS.items(), ("feeds", ["source_name", "loaded_at"])]) + " UNION ALL " + _digest(
    "(SELECT feed_id, stem, cols AS columns FROM fx_files)", "files", ["stem", "columns"])
_REPAIRED = " UNION ALL ".join(_digest(f"fx_{s}", s, STEM_COLUMNS[s]) for s in ("stops", "routes", "stop_times"))
Q["feed_repair"] = f"""SELECT f.source_name, d.stem, d.rows, d.digest, r.reason, r.outcome FROM ({_REPAIRED}) d
  JOIN fx_feeds f ON f.feed_id = d.feed_id LEFT JOIN (VALUES ('america_net.ZIP', 'stop_times', 'stale', 'repaired'),
    ('asia net (2019).zip', 'stop_times', 'stale', 'as in archive'), ('europe_net.ZIP', 'routes', 'missing', 'repaired'))
    r(source_name, stem, reason, outcome) ON r.source_name = f.source_name AND r.stem = d.stem"""
Q["kept_pair_summary"] = f"""SELECT d.*, NOT EXISTS (SELECT 1 FROM op_steps s WHERE s.feed_a = d.feed_a AND s.feed_b = d.feed_b) AS computed
  FROM ({Q["diff_summary"]}) d"""
Q["stream_ingest"] = "SELECT canonical_id, name, member_count, feed_count FROM op_canonstops"
Q["components"] = """, op_cedge AS (SELECT 'c:' || CAST(CAST(floor(lat * 50) AS BIGINT) AS VARCHAR) AS a, 'n:' || stop_id AS b FROM op_stops),
  op_cboth AS (SELECT a, b FROM op_cedge UNION SELECT b, a FROM op_cedge),
  op_cgo AS (SELECT a AS n, a AS m FROM op_cboth UNION SELECT g.n, e.b FROM op_cgo g JOIN op_cboth e ON e.a = g.m)
  SELECT n AS node, min(m) AS component FROM op_cgo GROUP BY 1"""


def _statement(sql: str) -> str:
    if sql.lstrip().startswith(","):
        head, tail = with_views(C, "SELECT * FROM (\n" + sql), ""
        cut = head.rindex("SELECT * FROM (\n")
        return head[:cut] + sql + tail
    return with_views(C, sql)


ORACLES: dict[str, str] = {name: _statement(sql.replace("$$$$", "''")) for name, sql in Q.items()}
