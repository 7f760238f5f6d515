"""Test inputs derived by rule from the driver tables: pings from events, and a lattice of roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geo

# The two statements that define the inputs, in SQL that Spark and DuckDB both run.
PINGS_SQL = """
WITH b AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM {events}),
w AS (
  SELECT *,
    SUM(CASE WHEN event_id%10<4 THEN 0 ELSE (event_id*7919)%401-200 END) OVER (PARTITION BY user_id ORDER BY seq)*10 AS cx,
    SUM(CASE WHEN event_id%10<4 THEN 0 ELSE (event_id*104729)%401-200 END) OVER (PARTITION BY user_id ORDER BY seq)*10 AS cy
  FROM b)
SELECT CAST(user_id AS BIGINT) AS trip_id, CAST(seq AS BIGINT) AS seq,
  CAST(1704067200 + user_id*86400 + seq*15 - CASE WHEN event_id%17=0 THEN 20 ELSE 0 END AS BIGINT) AS t_s,
  CAST(CASE WHEN event_id%97=0 THEN 0 ELSE 41130000 + ABS(((cy%80000)+80000)%80000-40000) + CASE WHEN event_id%41=0 THEN 60000 ELSE 0 END END AS BIGINT) AS lat_u,
  CAST(CASE WHEN event_id%97=0 THEN 0 ELSE -8630000 + ABS(((cx%80000)+80000)%80000-40000) END AS BIGINT) AS lon_u,
  CASE WHEN event_id%5=0 THEN NULL ELSE value/10.0 END AS hdop,
  CASE WHEN event_id%3=0 THEN NULL ELSE CAST((event_id*31)%300 AS DOUBLE)/10.0 END AS reported_speed
FROM w"""
LATTICE_SQL = """
WITH n AS (SELECT {id} AS id FROM range(0, 882)),
u AS (SELECT id AS base, id%2 AS vert, CAST(FLOOR(id/2) AS BIGINT) AS cell FROM n),
v AS (SELECT base, vert, cell, CAST(FLOOR(cell/21) AS BIGINT) AS r, cell%21 AS c FROM u),
e AS (SELECT base, r, c, vert, cell AS a, CASE WHEN vert=1 THEN cell+21 ELSE cell+1 END AS z FROM v WHERE (vert=1 AND r<20) OR (vert=0 AND c<20)),
d AS (SELECT base*2 AS link_id, a AS from_node, z AS to_node, r, c, vert FROM e
      UNION ALL SELECT base*2+1, z, a, r, c, vert FROM e WHERE (r*3+c*5+vert)%7<>0)
SELECT CAST(link_id AS BIGINT) AS link_id, CAST(from_node AS BIGINT) AS from_node, CAST(to_node AS BIGINT) AS to_node,
  CASE WHEN vert=0 THEN (CASE WHEN r%5=0 THEN 'primary' WHEN r%5=1 THEN 'secondary' ELSE 'residential' END)
       ELSE (CASE WHEN c%7=0 THEN 'motorway' WHEN c%7=1 THEN 'tertiary' ELSE 'service' END) END AS road_class,
  CAST(41130000 + CAST(FLOOR(from_node/21) AS BIGINT)*2000 AS BIGINT) AS from_lat_u,
  CAST(-8630000 + (from_node%21)*2000 AS BIGINT) AS from_lon_u,
  CAST(41130000 + CAST(FLOOR(to_node/21) AS BIGINT)*2000 AS BIGINT) AS to_lat_u,
  CAST(-8630000 + (to_node%21)*2000 AS BIGINT) AS to_lon_u
FROM d"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, seq (input order), t (seconds), lat, lon, hdop, reported_speed."""
    rows = spark.sql(PINGS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.select("trip_id", "seq", F.col("t_s").cast("double").alias("t"), (F.col("lat_u") / 1e6).alias("lat"), (F.col("lon_u") / 1e6).alias("lon"), F.col("hdop").cast("double").alias("hdop"), "reported_speed")


def lattice_records(spark: SparkSession) -> DataFrame:
    """link_id, from_node, to_node, road_class, coords, length_m: the input of network.build()."""
    rows = spark.sql(LATTICE_SQL.replace("{id}", "id"))
    point = lambda end: F.struct((F.col(f"{end}_lon_u") / 1e6).alias("lon"), (F.col(f"{end}_lat_u") / 1e6).alias("lat"))
    rows = rows.select("link_id", "road_class", "from_node", "to_node", F.array(point("from"), point("to")).alias("coords"))
    return rows.withColumn("max_speed_ms", geo.speed_cap(F.col("road_class"))).withColumn("length_m", geo.line_length_m(F.col("coords")))
