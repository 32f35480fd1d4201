"""Spatial views over the relational test tables: one SQL text each, plain enough for any engine.

The tables hold no coordinates, so these derive grid squares, pixels, units
and polygons from keys by integer arithmetic. ``{table}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    # grid rows as published: text with markers and decimal commas
    "grid_rows": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, east, north, concat('CRS3035RES100mN', CAST(north AS STRING), 'E', CAST(east AS STRING)) AS grid_id,
  CASE WHEN l_orderkey % 10 = 0 THEN '–' WHEN l_orderkey % 10 = 1 THEN '.' WHEN l_orderkey % 10 = 2 THEN '-1' ELSE concat(' ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ',0') END AS value_text,
  CASE WHEN l_partkey % 11 = 0 THEN '/' ELSE CAST(l_linenumber AS STRING) END AS weight_text
FROM (SELECT *, 4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS east, 3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS north FROM {lineitem}) AS g""",
    # the same rows, parsed
    "grid_values": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, grid_id, CAST(east + 50 AS DOUBLE) AS x, CAST(north + 50 AS DOUBLE) AS y,
  CASE WHEN l_orderkey % 10 = 0 THEN 0.0 WHEN l_orderkey % 10 IN (1, 2) THEN NULL ELSE l_quantity END AS v,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS w
FROM (SELECT *, 4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS east, 3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS north,
  concat('CRS3035RES100mN', CAST(3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS STRING), 'E', CAST(4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS STRING)) AS grid_id FROM {lineitem}) AS g""",
    # a second file of weights, keys repeated in file order
    "weight_rows": """
SELECT concat('CRS3035RES100mN', CAST(3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS STRING), 'E', CAST(4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS STRING)) AS grid_id,
  (l_orderkey * 64 + l_partkey % 64) * 1000000 + l_suppkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 AS seq,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) % 10 AS DOUBLE) END AS weight
FROM {lineitem}""",
    # one count column for each part type
    "category_rows": """
SELECT grid_id, x, y, CASE WHEN k = 0 THEN v END AS c0, CASE WHEN k = 1 THEN v END AS c1, CASE WHEN k = 2 THEN v END AS c2, CASE WHEN k = 3 THEN v ELSE 0.0 END AS c3
FROM (SELECT l_partkey % 4 AS k, CAST(4300050 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS DOUBLE) AS x, CAST(3000050 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS DOUBLE) AS y,
  concat('CRS3035RES100mN', CAST(3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS STRING), 'E', CAST(4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS STRING)) AS grid_id,
  CASE WHEN l_orderkey % 10 IN (1, 2) THEN NULL ELSE l_quantity END AS v FROM {lineitem}) AS g""",
    # a census, one grid square for each order, as text with the markers of the published tables; its fractions are exact in binary, so sums are exact in any order
    "census_text": """
SELECT k, concat('CRS3035RES100mN', CAST(north AS STRING), 'E', CAST(east AS STRING)) AS grid_id, CAST(east + 50 AS STRING) AS x, CAST(north + 50 AS STRING) AS y,
  CASE WHEN k % 10 = 0 THEN '–' WHEN k % 10 = 1 THEN '.' ELSE CAST(p % 97 AS STRING) END AS people, CASE WHEN k % 6 = 0 THEN '-1' ELSE CAST(p % 89 AS STRING) END AS people_before,
  CASE WHEN k % 11 = 0 THEN '/' ELSE concat(CAST(20 + p % 50 AS STRING), CASE WHEN p % 2 = 0 THEN ',0' ELSE ',5' END) END AS age,
  CASE WHEN k % 9 = 0 THEN '–' ELSE CAST(p % 31 AS STRING) END AS rented, CASE WHEN k % 13 = 0 THEN '...' ELSE concat(CAST(4 + p % 9 AS STRING), CASE WHEN c % 2 = 0 THEN ',25' ELSE ',5' END) END AS rent,
  CASE WHEN k % 17 = 0 THEN '–' ELSE CAST(1 + p % 40 AS STRING) END AS dwellings, CASE WHEN k % 8 = 0 THEN '–' ELSE CAST(p % 5 AS STRING) END AS built,
  CASE WHEN k % 19 = 0 THEN 'x' ELSE concat(CAST(c % 30 AS STRING), CASE WHEN p % 2 = 0 THEN ',0' ELSE ',75' END) END AS vacancy, CASE WHEN k % 7 = 0 THEN '–' WHEN c % 3 = 0 THEN '1,0' WHEN c % 3 = 1 THEN '2,0' ELSE '4,0' END AS household,
  CASE WHEN k % 4 = 0 THEN '–' ELSE CAST(p % 7 AS STRING) END AS h0, CASE WHEN k % 4 = 1 THEN '–' ELSE CAST(p % 11 AS STRING) END AS h1, CASE WHEN k % 4 = 2 THEN '.' ELSE CAST(p % 13 AS STRING) END AS h2
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, 4200000 + 100 * (o_orderkey % 2000) AS east, 2800000 + 100 * CAST(floor(o_orderkey / 2000) AS BIGINT) AS north FROM {orders}) AS o""",
    # the same census in numbers
    "census_values": """
SELECT k, CAST(east + 50 AS DOUBLE) AS x, CAST(north + 50 AS DOUBLE) AS y,
  CASE WHEN k % 10 = 0 THEN 0.0 WHEN k % 10 = 1 THEN NULL ELSE CAST(p % 97 AS DOUBLE) END AS people, CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(p % 89 AS DOUBLE) END AS people_before,
  CASE WHEN k % 11 = 0 THEN NULL ELSE 20 + p % 50 + CAST(p % 2 AS DOUBLE) / 2 END AS age,
  CASE WHEN k % 9 = 0 THEN 0.0 ELSE CAST(p % 31 AS DOUBLE) END AS rented, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(4.25 AS DOUBLE) + p % 9 + CAST(c % 2 AS DOUBLE) / 4 END AS rent,
  CASE WHEN k % 17 = 0 THEN 0.0 ELSE CAST(1 + p % 40 AS DOUBLE) END AS dwellings, CASE WHEN k % 8 = 0 THEN 0.0 ELSE CAST(p % 5 AS DOUBLE) END AS built,
  CASE WHEN k % 19 = 0 THEN NULL ELSE c % 30 + 3 * CAST(p % 2 AS DOUBLE) / 4 END AS vacancy, CASE WHEN k % 7 = 0 THEN 0.0 WHEN c % 3 = 0 THEN 1.0 WHEN c % 3 = 1 THEN 2.0 ELSE 4.0 END AS household,
  CASE WHEN k % 4 = 0 THEN 0.0 ELSE CAST(p % 7 AS DOUBLE) END AS h0, CASE WHEN k % 4 = 1 THEN 0.0 ELSE CAST(p % 11 AS DOUBLE) END AS h1, CASE WHEN k % 4 = 2 THEN NULL ELSE CAST(p % 13 AS DOUBLE) END AS h2
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, 4200000 + 100 * (o_orderkey % 2000) AS east, 2800000 + 100 * CAST(floor(o_orderkey / 2000) AS BIGINT) AS north FROM {orders}) AS o""",
    # a register of units
    "units": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 6.0 + CAST(o_orderkey * 13 % 8000 AS DOUBLE) / 1000.0 END AS lon, 47.5 + CAST(o_custkey * 17 % 7000 AS DOUBLE) / 1000.0 AS lat,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) END AS kw, CAST(o_orderdate AS DATE) AS commissioned,
  CASE o_orderkey % 4 WHEN 0 THEN 35 WHEN 1 THEN 31 WHEN 2 THEN 37 ELSE 38 END AS status,
  CASE WHEN o_orderkey % 8 = 3 THEN CAST('2000-06-15' AS DATE) END AS decommissioned, CASE WHEN o_orderkey % 9 = 0 THEN 889 ELSE 888 END AS lage
FROM {orders}""",
    # pixels of yearly tiles with a quality layer
    "pixels": """
SELECT CAST(extract(year FROM l_shipdate) AS BIGINT) AS step, CASE WHEN l_suppkey % 2 = 0 THEN 'h18v03' ELSE 'h18v04' END AS tile, (l_orderkey * 7 + l_partkey) % 2400 AS r, (l_partkey * 5 + l_suppkey * 3) % 2400 AS c,
  CASE WHEN l_orderkey % 11 = 0 THEN -999 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS raw, l_linenumber % 4 AS quality
FROM {lineitem}""",
    # pixels of a forest raster, each place once
    "forest_pixels": """
SELECT r, c, CAST(min(mask) AS BIGINT) AS mask, CAST(min(latest) AS BIGINT) AS latest, CAST(min(agent) AS BIGINT) AS agent
FROM (SELECT l_orderkey % 60 AS r, l_partkey % 60 AS c, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 1 END AS mask, CASE WHEN l_linenumber % 3 = 0 THEN 2018 + l_orderkey % 5 ELSE 0 END AS latest, 1 + l_partkey % 4 AS agent FROM {lineitem}) AS p
GROUP BY r, c""",
    # square polygons, every fifth with a hole; sides in metres
    "squares": """
SELECT c_custkey AS id, concat(CAST(1 + c_custkey % 4 AS STRING), CAST(1 + c_nationkey % 2 AS STRING), CAST(1 + c_custkey % 3 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END) AS code,
  CAST(4300000 + (c_custkey * 7919) % 20000 AS DOUBLE) AS x0, CAST(3000000 + (c_custkey * 104729) % 20000 AS DOUBLE) AS y0, CAST(200 + (c_custkey * 37) % 1000 AS DOUBLE) AS side, c_custkey % 5 = 0 AS hole
FROM {customer}""",
    "places": """
SELECT n_nationkey AS ord, n_name AS name, 1 + n_nationkey % 3 AS tier, 10.0 + CAST(n_nationkey * 7 % 25 AS DOUBLE) / 20.0 AS lon, 50.0 + CAST(n_nationkey * 11 % 25 AS DOUBLE) / 20.0 AS lat
FROM {nation}""",
    # points near the places
    "points": """
SELECT o_orderkey AS id, 10.0 + CAST(o_orderkey * 13 % 3000 AS DOUBLE) / 2000.0 AS lon, 50.0 + CAST(o_custkey * 17 % 3000 AS DOUBLE) / 2000.0 AS lat, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS DOUBLE) AS height
FROM {orders}""",
    # a catalog of metrics by dataset, and modes that read them
    "metrics": """
SELECT DISTINCT concat('ds', CAST(user_id AS STRING)) AS dataset, concat(CASE WHEN event_id % 3 = 0 THEN 'height_' ELSE 'colour_' END, CAST(2000 + event_id % 4 AS STRING)) AS metric, CASE WHEN event_id % 3 = 0 THEN 'height' ELSE 'colour' END AS kind, event_id % 4 AS step_no
FROM {events}""",
    # events as successive runs that describe metrics of datasets
    "runs": """
SELECT event_id AS run, concat('ds', CAST(user_id % 6 AS STRING)) AS dataset, concat('m', CAST(event_id % 4 AS STRING)) AS metric, CAST(6 + event_id % 4 AS BIGINT) AS res,
  concat('label ', event_type) AS label, CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) AS top, concat('2024-01-', CASE WHEN extract(day FROM ts) < 10 THEN '0' ELSE '' END, CAST(extract(day FROM ts) AS STRING)) AS reference_date
FROM {events}""",
    # files of a download folder
    "files": """
SELECT event_id AS id, concat('VNP46A4.A', CAST(2012 + event_id % 5 AS STRING), '001.h', CAST(18 + user_id % 2 AS STRING), 'v0', CAST(3 + event_id % 2 AS STRING), '.', CAST(100000 + event_id * 7919 % 99991 AS STRING), CASE WHEN event_id % 6 = 0 THEN '.xml' ELSE '.h5' END) AS name,
  CAST(floor(value) AS BIGINT) AS size, CAST(event_id * 1000 AS BIGINT) AS mtime, concat('level', CAST(user_id % 4 AS STRING)) AS folder, props
FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables, of one folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in TABLES if f"{{{t}}}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql(name: str) -> str:
    """The view's text for an engine where the tables go by their own names."""
    return VIEWS[name].format(**{t: t for t in TABLES})
