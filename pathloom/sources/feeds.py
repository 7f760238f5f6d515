"""Sources and sinks: trip CSVs with polylines, road tables, labels, weights and calibration records."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.config import N_FEATURES, fitted_weights

TRIP_CSV = "TRIP_ID string, CALL_TYPE string, ORIGIN_CALL string, ORIGIN_STAND string, TAXI_ID string, TIMESTAMP long, DAY_TYPE string, MISSING_DATA string, POLYLINE string"
PING_SECONDS = 15
LABEL_VERSION = 3


def polyline(text: Column) -> Column:
    """array<array<double>> of a JSON polyline; null if malformed."""
    return F.from_json(text, "array<array<double>>")


def exploded(trips: DataFrame, missing_ok: bool = False, least_pings: int = 2) -> DataFrame:
    """Pings (trip_id, seq, t, lat, lon) of trips (TRIP_ID, TIMESTAMP, MISSING_DATA, POLYLINE); a ping that is no pair leaves a gap in time."""
    rows = trips.select(F.col("TRIP_ID").alias("trip_id"), F.col("TIMESTAMP").alias("t0"), "MISSING_DATA", polyline(F.col("POLYLINE")).alias("points"))
    if not missing_ok:
        rows = rows.where(F.lower(F.coalesce(F.col("MISSING_DATA").cast("string"), F.lit("false"))) != "true")
    whole = F.size(F.filter("points", lambda p: (F.size(p) >= 2)))
    rows = rows.where(whole >= least_pings).select("trip_id", "t0", F.posexplode("points").alias("seq", "p")).where(F.size("p") >= 2)
    return rows.select("trip_id", F.col("seq").cast("long").alias("seq"), (F.col("t0") + PING_SECONDS * F.col("seq")).cast("double").alias("t"), F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"), F.lit(None).cast("double").alias("hdop"), F.lit(None).cast("double").alias("reported_speed"))


def read_trips_csv(spark: SparkSession, path: str, missing_ok: bool = False, least_pings: int = 2) -> DataFrame:
    """Pings of a trip CSV; four columns are parsed."""
    trips = spark.read.csv(path, schema=TRIP_CSV, header=True, quote='"', escape='"').select("TRIP_ID", "TIMESTAMP", "MISSING_DATA", "POLYLINE")
    return exploded(trips, missing_ok, least_pings)


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Road records from ways (way_id, road_class, oneway, maxspeed, nodes array<long>) and nodes (node_id, lat, lon).

    Ways are cut at inner nodes that are referred to twice or more. A way's first emitted edge
    keeps its id; the others get ids from 10**12 on, in order of way, piece and direction.
    """
    from pyspark.sql import Window

    from pathloom.functions import geo

    refs = ways.select("way_id", "road_class", "oneway", "maxspeed", F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "node_id"))
    shared = refs.groupBy("node_id").count().where("count >= 2").select("node_id", F.lit(1).alias("cut"))
    way = Window.partitionBy("way_id").orderBy("i")
    cuts = refs.join(shared, "node_id", "left").join(nodes, "node_id")
    # A cut node ends one piece and begins the next, so it stands in both.
    inner = F.coalesce("cut", F.lit(0)) * ((F.col("i") > 0) & (F.col("i") < F.col("n") - 1)).cast("int")
    cuts = cuts.withColumn("begins", F.sum(inner).over(way)).withColumn("piece", F.explode(F.when(inner == 1, F.array(F.col("begins") - 1, F.col("begins"))).otherwise(F.array("begins"))))
    pieces = cuts.groupBy("way_id", "piece", "road_class", "oneway", "maxspeed").agg(F.array_sort(F.collect_list(F.struct("i", "node_id", "lon", "lat"))).alias("p")).where(F.size("p") >= 2)
    both = F.filter(F.array(F.when(F.col("d.forward"), F.lit(False)), F.when(F.col("d.backward"), F.lit(True))), lambda x: x.isNotNull())
    made = pieces.withColumn("d", geo.directions(F.col("road_class"), F.col("oneway"))).withColumn("back", F.explode(both)).withColumn("p", F.when(F.col("back"), F.reverse("p")).otherwise(F.col("p")))
    made = made.withColumn("rank", F.row_number().over(Window.partitionBy("way_id").orderBy("piece", "back")))
    # Numbers of later edges: a prefix sum over ways, then the place in the way.
    extra = made.groupBy("way_id").agg((F.count("*") - 1).alias("n"))
    base = extra.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("way_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("way_id", "base")
    made = made.join(base, "way_id")
    coords = F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    made = made.withColumn("coords", coords)
    return made.select(
        F.when(F.col("rank") == 1, F.col("way_id")).otherwise(F.lit(10**12) + F.col("base") + F.col("rank") - 2).alias("link_id"),
        "road_class", geo.parsed_maxspeed(F.col("maxspeed"), F.col("road_class")).alias("max_speed_ms"), "coords",
        F.col("p")[0]["node_id"].alias("from_node"), F.element_at("p", -1)["node_id"].alias("to_node"), geo.line_length_m(F.col("coords")).alias("length_m"),
    )


def control_nodes(nodes: DataFrame) -> DataFrame:
    """kind ('signal' or 'stop'), node_id of nodes with tags map<string,string>."""
    kind = F.when(F.col("tags")["highway"] == "traffic_signals", "signal").when(F.col("tags")["highway"] == "stop", "stop")
    return nodes.select(kind.alias("kind"), "node_id").where("kind is not null")


def control_path(edges_path: str) -> str:
    """The control-node table that goes with an edge table."""
    return f"{edges_path.removesuffix('.parquet').removesuffix('_edges')}_signal_stop_nodes.parquet"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; written from build() first if it is not there."""
    if not _exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def load_network(spark: SparkSession, edges_path: str, ways: DataFrame | None = None, nodes: DataFrame | None = None):
    """Road records and control nodes, read through their tables."""
    records = cached(spark, edges_path, lambda: way_edges(ways, nodes.select("node_id", "lat", "lon")))
    controls = cached(spark, control_path(edges_path), lambda: control_nodes(nodes))
    return records, controls


def write_weights(spark: SparkSession, weights: list[float], path: str) -> None:
    spark.createDataFrame(list(enumerate(map(float, weights))), "slot int, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str | None) -> tuple[float, ...]:
    """Stored weights, or zeros where there are none."""
    if path is None or not _exists(spark, path):
        return fitted_weights(None)
    return fitted_weights([r.weight for r in spark.read.parquet(path).orderBy("slot").limit(N_FEATURES + 1).collect()])


def write_labels(labels: DataFrame, path: str, header: dict[str, str]) -> None:
    """Labels with a one-row header table beside them."""
    spark = labels.sparkSession
    head = {"schema_version": str(LABEL_VERSION), "feature_dim": str(N_FEATURES)} | header
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    spark.createDataFrame(sorted(head.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    head = {r.name: r.value for r in spark.read.parquet(f"{path}/header").collect()}
    if head.get("feature_dim") != str(N_FEATURES):
        raise ValueError(f"labels have {head.get('feature_dim')} features, not {N_FEATURES}")
    return spark.read.parquet(f"{path}/labels")


def write_records(records: DataFrame, path: str, keying: str) -> None:
    records.withColumn("keying", F.lit(keying)).write.mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str, keying: str) -> DataFrame:
    rows = spark.read.parquet(path)
    other = rows.where(F.col("keying") != keying).limit(1).collect()
    if other:
        raise ValueError(f"records are keyed by {other[0].keying}, not {keying}")
    return rows.drop("keying")


def data_path(name: str, default: str) -> str:
    """An input path from the environment, looked up when asked for."""
    return os.environ.get(name, default)
