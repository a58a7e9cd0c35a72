"""GTFS-shaped views over the given tables, written once in SQL both Spark and DuckDB run.

customer -> routes and shapes, orders -> trips, lineitem -> stop_times, part -> stops, supplier -> calendar
and districts, nation -> agencies, region -> the five feed releases ``F0``..``F4``, labels -> truth pairs,
benchmark -> overrides, events -> population pixels. Every view grows with its table.
"""

from __future__ import annotations

import re

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]


def div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}e0) AS BIGINT)"


def s(e: str) -> str:
    return f"CAST({e} AS STRING)"


def deg(e: str) -> str:
    return f"({s(div(e, 1000000))} || '.' || lpad({s(f'({e}) % 1000000')}, 6, '0'))"


def base_lat(q: str) -> str:
    return f"(47000000 + ({q}) * 7919 % 900000)"


def base_lon(q: str) -> str:
    return f"(13000000 + ({q}) * 104729 % 1900000)"


def route_id(c: str) -> str:
    return f"(CASE WHEN ({c}) % 3 = 0 THEN 'R' || {s('k')} || '-' || {s(c)} ELSE 'R' || {s(c)} END)"


def stop_id(p: str, k: str = "k") -> str:
    return f"(CASE WHEN ({p}) % 4 = 0 THEN 'st:' || {s(k)} || ':' || {s(p)} ELSE 'st:' || {s(p)} END)"


CUST = div("o_orderkey", 10)
LCUST = div("l_orderkey", 10)
LSTOP = f"(CASE WHEN l_linenumber = 4 THEN {LCUST} - {LCUST} % 50 ELSE {LCUST} + 3 * l_linenumber END)"
CLUSTER = div("p_partkey", 3)
SHAPE_LAT = f"""({base_lat(div('c_custkey', 3))} + 20 + i * (c_custkey % 3) * 200 + d * 90
  + CASE WHEN k = 3 AND c_custkey % 7 = 1 AND i BETWEEN 2 AND 4 THEN 700 ELSE 0 END
  + CASE WHEN k = 3 AND c_custkey % 7 = 3 THEN 5000 ELSE 0 END
  + CASE WHEN k >= 3 AND c_custkey % 7 = 5 AND i = 1 THEN 90 ELSE 0 END)"""
SHAPE_LON = f"({base_lon(div('c_custkey', 3))} + 20 + i * 1500)"
SHAPE_N = "(5 + c_custkey % 5 + CASE WHEN k >= 3 AND c_custkey % 7 = 2 THEN 3 ELSE 0 END)"

VIEWS: dict[str, str] = {
    "fx_feeds": f"""
        SELECT 'F' || {s('r_regionkey')} AS feed_id,
               lower(r_name) || CASE WHEN r_regionkey % 2 = 0 THEN ' net (2019).zip' ELSE '_net.ZIP' END AS source_name,
               1500000000000 + r_regionkey * 32500000000 AS loaded_at
        FROM {{region}}""",
    "fx_files": f"""
        SELECT 'F' || {s('r_regionkey')} AS feed_id, 'agency' AS stem, 'agency_id,agency_name' AS cols FROM {{region}}
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'stops', 'stop_id,stop_name,stop_lat,stop_lon' FROM {{region}}
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'routes',
          CASE WHEN r_regionkey = 4 THEN 'route_id,route_short_name,route_long_name,route_type'
               ELSE 'route_id,agency_id,route_short_name,route_long_name,route_type' END FROM {{region}}
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'trips',
          'trip_id,route_id,service_id,direction_id,trip_headsign,shape_id' FROM {{region}}
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'stop_times',
          CASE WHEN r_regionkey = 2 THEN 'stop_id,trip_id,stop_sequence'
               ELSE 'stop_id,trip_id,stop_sequence,departure_time' END FROM {{region}}
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'calendar', 'service_id,monday,start_date,end_date'
          FROM {{region}} WHERE r_regionkey <> 3
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'shapes', 'shape_id,shape_pt_lon,shape_pt_lat,shape_pt_sequence'
          FROM {{region}}
        UNION ALL SELECT 'F' || {s('r_regionkey')}, 'feed_info', 'feed_start_date,feed_end_date'
          FROM {{region}} WHERE r_regionkey <> 2""",
    "fx_feed_info": f"""
        SELECT 'F' || {s('r_regionkey')} AS feed_id,
               CASE WHEN r_regionkey = 1 THEN NULL ELSE {s('2020 + r_regionkey')} || '0105' END AS feed_start_date,
               CASE WHEN r_regionkey IN (1, 4) THEN NULL ELSE {s('2020 + r_regionkey')} || '1220' END AS feed_end_date
        FROM {{region}} WHERE r_regionkey <> 2""",
    "fx_calendar": f"""
        SELECT 'F' || {s('k')} AS feed_id, 'S' || {s('s_suppkey')} AS service_id,
               {", ".join(f"{s(f'CASE WHEN (s_suppkey * {m} + k) % {n} < {n - 1} THEN 1 ELSE 0 END')} AS {d}"
                          for d, m, n in [("monday", 1, 9), ("tuesday", 2, 9), ("wednesday", 3, 5),
                                          ("thursday", 1, 7), ("friday", 1, 8), ("saturday", 1, 2),
                                          ("sunday", 1, 3)])},
               {s('2020 + k')} || lpad({s('1 + s_suppkey % 3')}, 2, '0') || '01' AS start_date,
               {s('2020 + k')} || {s('10 + s_suppkey % 3')} || '28' AS end_date
        FROM {{supplier}} {{feeds}} WHERE k <> 3""",
    "fx_agency": f"""
        SELECT 'F' || {s('k')} AS feed_id, 'A' || {s('n_nationkey')} AS agency_id,
               CASE WHEN k >= 2 AND n_nationkey % 5 = 0 THEN replace(n_name, '_', ' ')
                    WHEN k >= 3 AND n_nationkey % 7 = 1 THEN n_name || ' Öffi'
                    WHEN n_nationkey = 24 THEN NULL ELSE n_name END AS agency_name
        FROM {{nation}} {{feeds}}""",
    "fx_routes": f"""
        SELECT 'F' || {s('k')} AS feed_id, {route_id('c_custkey')} AS route_id,
               CASE WHEN k = 4 THEN NULL ELSE 'A' || {s(div('c_custkey', 6) + ' % 25')} END AS agency_id,
               CASE WHEN k >= 2 AND c_custkey % 13 = 4 THEN 'X ' || {s('c_custkey')}
                    WHEN c_custkey % 8 = 7 THEN NULL
                    WHEN c_custkey % 4 = 2 THEN 'n ' || {s(div('c_custkey', 2))}
                    WHEN c_custkey % 16 = 5 THEN {s(div('c_custkey', 2))} || 'ä'
                    ELSE {s(div('c_custkey', 2))} END AS route_short_name,
               CASE WHEN k >= 3 AND c_custkey % 9 = 2 THEN c_mktsegment || ' Linie ' || {s('c_custkey')} || ' Express'
                    WHEN k % 2 = 1 THEN lower(c_mktsegment) || '-Linie  ' || {s('c_custkey')}
                    ELSE c_mktsegment || ' Linie ' || {s('c_custkey')} END AS route_long_name,
               CASE WHEN c_custkey % 101 = 7 THEN 'x' ELSE
                 CASE {div('c_custkey', 6)} % 8 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3'
                   WHEN 4 THEN '700' WHEN 5 THEN '900' WHEN 6 THEN '106' ELSE '1500' END END AS route_type
        FROM {{customer}} {{feeds}} WHERE (c_custkey + k) % 11 <> 0""",
    "fx_trips": f"""
        SELECT 'F' || {s('k')} AS feed_id, 'T' || {s('k')} || '_' || {s('o_orderkey')} AS trip_id,
               {route_id(CUST)} AS route_id, 'S' || {s('o_custkey % 120')} AS service_id,
               CASE WHEN o_orderkey % 30 = 9 OR (k = 3 AND {CUST} % 7 = 6) THEN NULL
                    ELSE {s('o_orderkey % 2')} END AS direction_id,
               CASE WHEN o_orderkey % 10 < 5 THEN '' ELSE 'Richtung ' || {s(f'{CUST} % 9')} END AS trip_headsign,
               CASE WHEN o_orderkey % 17 = 3 THEN NULL
                    ELSE 'SH' || {s(CUST)} || '_' || {s('o_orderkey % 2')} END AS shape_id
        FROM {{orders}} {{feeds}} WHERE (o_orderkey + k) % 5 <> 0""",
    "fx_stop_times": f"""
        SELECT 'F' || {s('k')} AS feed_id, {stop_id(LSTOP)} AS stop_id,
               'T' || {s('k')} || '_' || {s('l_orderkey')} AS trip_id,
               CASE WHEN l_orderkey % 2 = 0 THEN {s('l_linenumber')} ELSE {s('8 - l_linenumber')} END AS stop_sequence,
               CASE WHEN k = 2 THEN NULL WHEN l_orderkey % 53 = 1 THEN 'soon'
                    ELSE {s('4 + (l_orderkey * 7 + l_linenumber) % 22')} || ':' ||
                         lpad({s('(l_orderkey * 3 + l_linenumber * 5) % 60')}, 2, '0') || ':00' END AS departure_time
        FROM {{lineitem}} {{feeds}} WHERE (l_orderkey + k) % 5 <> 0""",
    "fx_stops": f"""
        SELECT 'F' || {s('k')} AS feed_id, {stop_id('p_partkey')} AS stop_id,
               CASE WHEN p_partkey % 89 = 3 THEN NULL
                    WHEN p_partkey % 15 = 8 AND k >= 2 THEN 'Neuer Markt ' || {s(CLUSTER)}
                    WHEN p_partkey % 3 = 0 THEN 'Großer Platz ' || {s(CLUSTER)} || ' Bahnhof (ÖBB)'
                    WHEN p_partkey % 3 = 1 THEN 'Grosser Plätz ' || {s(CLUSTER)} || '/Steig ' || {s('1 + p_partkey % 4')}
                    ELSE p_name || ' - ' || {s(CLUSTER)} || CASE WHEN k % 2 = 1 THEN ' Hst.' ELSE '' END END AS stop_name,
               CASE WHEN p_partkey % 97 = 5 AND k = 1 THEN 'n/a' ELSE {deg(
                   base_lat(CLUSTER) + " + (p_partkey % 3) * 60 + k * 2"
                   " + CASE WHEN p_partkey % 10 = 5 AND k >= 3 THEN 400 ELSE 0 END"
                   " + CASE WHEN p_partkey % 10 = 7 AND k >= 2 THEN 3000 ELSE 0 END")} END AS stop_lat,
               {deg(base_lon(CLUSTER) + " + (p_partkey % 3) * 50")} AS stop_lon
        FROM {{part}} {{feeds}} WHERE (p_partkey + 2 * k) % 13 <> 0""",
    "fx_shapes": f"""
        SELECT 'F' || {s('k')} AS feed_id, 'SH' || {s('c_custkey')} || '_' || {s('d')} AS shape_id,
               {deg(SHAPE_LON)} AS shape_pt_lon, {deg(SHAPE_LAT)} AS shape_pt_lat,
               CASE WHEN d = 0 THEN {s('i * 10')} ELSE {s('900 - i * 10')} END AS shape_pt_sequence
        FROM {{customer}} {{feeds}} {{dirs}} {{points}}
        WHERE (c_custkey + k) % 11 <> 0 AND i < {SHAPE_N}""",
    "fx_truth": f"""
        SELECT 'stop' AS kind, 'F0' AS feed_a, {stop_id('doc_id', '0')} AS raw_a, 'F4' AS feed_b,
               {stop_id('doc_id + CASE WHEN quality = 1 THEN 0 ELSE 1 END', '4')} AS raw_b,
               quality = 1 AS same
        FROM {{labels}}
        UNION ALL
        SELECT 'route', 'F0', 'R' || {s('doc_id')}, 'F3', 'R' || {s('doc_id + toxic')}, toxic = 0 FROM {{labels}}""",
    "fx_overrides": f"""
        SELECT 'stop' AS kind, 'merge' AS op, item_id AS group_id, 0 AS pos, 'F0' AS feed_id,
               'st:' || {s('item_id * 4 + 1')} AS raw_id, 'Merged ' || {s('item_id')} AS label FROM {{benchmark}}
        UNION ALL SELECT 'stop', 'merge', item_id, 1, 'F1', 'st:' || {s('item_id * 4 + 10')}, 'Merged ' || {s('item_id')}
          FROM {{benchmark}}
        UNION ALL SELECT 'stop', 'merge', item_id, 2, 'F0', 'st:' || {s('item_id * 4 + 5')}, 'Merged ' || {s('item_id')}
          FROM {{benchmark}} WHERE item_id % 3 = 0
        UNION ALL SELECT 'stop', 'unmerge', item_id, 0, 'F2', 'st:' || {s('item_id * 4 + 3')}, NULL FROM {{benchmark}}
        UNION ALL SELECT 'route', 'unmerge', item_id, 0, 'F1', 'R' || {s('item_id * 3 + 1')}, NULL FROM {{benchmark}}
        UNION ALL SELECT 'route', 'merge', item_id, pos, 'F0', 'R' || {s('item_id * 3 + 2 + pos * 3')}, 'Lines'
          FROM {{benchmark}} {{pos2}}""",
    "fx_districts": f"""
        SELECT 'D' || {s('s_suppkey')} AS g_id, 'Sprengel ' || {s('s_suppkey')} AS g_name,
               '{{{{"type":"Polygon","id":' || {s('s_suppkey')} || '}}}}' AS geometry,
               13e0 + (s_suppkey * 17 % 190) / 100e0 AS min_lon, 47e0 + (s_suppkey * 29 % 90) / 100e0 AS min_lat,
               13.02e0 + (s_suppkey * 17 % 190) / 100e0 AS max_lon, 47.02e0 + (s_suppkey * 29 % 90) / 100e0 AS max_lat
        FROM {{supplier}}""",
    "fx_district_pop": f"""
        SELECT 'D' || {s('s_suppkey')} AS g_id, CAST(floor(s_acctbal) AS BIGINT) AS population
        FROM {{supplier}} WHERE s_suppkey % 9 <> 4""",
    "fx_pop_pixels": f"""
        SELECT CASE event_id % 3 WHEN 0 THEN 2010 WHEN 1 THEN 2021 ELSE 2025 END AS yr,
               49500 + event_id * 7 % 1100 AS px_row, 231800 + event_id * 13 % 2200 AS px_col,
               CAST(floor(value * 10) AS BIGINT) AS value
        FROM {{events}}""",
}
# Joins with a list of values, not explode: Spark's size estimate of a join is the product of its sides, while that of
# an exploded view stays the given table's, by which millions of rows would be sent to every task as a small side.
_SPARK = {
    "feeds": "CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS fv(k)",
    "dirs": "CROSS JOIN (VALUES (0), (1)) AS dv(d)",
    "points": f"CROSS JOIN (VALUES {', '.join(f'({i})' for i in range(12))}) AS pv(i)",
    "pos2": "CROSS JOIN (VALUES (0), (1)) AS qv(pos)",
}
_DUCK = {
    "feeds": "CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) fv",
    "dirs": "CROSS JOIN (SELECT unnest([0, 1]) AS d) dv",
    "points": "CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS i) pv",
    "pos2": "CROSS JOIN (SELECT unnest([0, 1]) AS pos) qv",
}


def spark_view(spark, sf_dir: str, name: str):
    names = {t: _source(spark, sf_dir, t) if "{" + t + "}" in VIEWS[name] else t for t in BASE}
    return spark.sql(VIEWS[name].format(**_SPARK, **names))


def _source(spark, sf_dir: str, table: str) -> str:
    """Temporary view of a given table; a lone small file is spread over the cores before views multiply it."""
    view = f"src_{table}_{re.sub(r'[^a-z0-9]', '_', sf_dir.lower())}"
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table in ("customer", "orders", "lineitem", "part", "events") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    df.createOrReplaceTempView(view)
    return view


def duck_view(name: str) -> str:
    return VIEWS[name].format(**_DUCK, **{t: t for t in BASE})


def with_views(ctes: dict[str, str], sql: str) -> str:
    """Prefix ``sql`` with the fixture views and named CTEs it needs, directly or through each other."""
    pool = {n: duck_view(n) for n in VIEWS} | ctes
    need: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|op)_\w+\b", text)):
            if name in pool and name not in need:
                visit(pool[name].replace(name, "") if "RECURSIVE" in pool[name] else pool[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({pool[n].replace('/*RECURSIVE*/', '')})" for n in need) + "\n" + sql
