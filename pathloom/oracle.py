"""DuckDB twins of the registered queries."""

from __future__ import annotations

import math

from pathloom.config import CLASS_SLOTS, SPEED_CAPS, TYPICAL_SPEEDS
from pathloom.sources.derived import LATTICE_SQL, PINGS_SQL


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0e0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def azi(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(({x} + 360.0e0) % 360.0e0)"


def plane(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow(({c} - {a}) * 111320.0e0, 2) + pow(({d} - {b}) * 111320.0e0 * cos(radians({a})), 2))"


def by_class(table: dict[str, float], other: float, c: str = "road_class") -> str:
    return f"coalesce(CASE regexp_replace({c}, '_link$', '') " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" END, {other}::DOUBLE)"


PINGS = f"p0 AS ({PINGS_SQL.replace('{events}', 'events')}), pings AS (SELECT trip_id, seq, t_s::DOUBLE AS t, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, hdop::DOUBLE AS hdop, reported_speed FROM p0)"
CLEAN = f"""{PINGS}, v0 AS (SELECT *, max(t) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM pings
  WHERE NOT (lat = 0 AND lon = 0) AND abs(lat) <= 90 AND abs(lon) <= 180 AND (hdop IS NULL OR hdop <= 10)),
clean AS (SELECT trip_id, seq, t, lat, lon, hdop, reported_speed FROM v0 WHERE latest IS NULL OR t > latest),
num AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq) - 1 AS n FROM clean)"""
RUNS = f"""{CLEAN}, walk AS (
  SELECT trip_id, n, lat AS alat, lon AS alon, 0 AS k FROM num WHERE n = 0
  UNION ALL SELECT x.trip_id, x.n, CASE WHEN {hav('alat', 'alon', 'x.lat', 'x.lon')} > 5 THEN x.lat ELSE alat END, CASE WHEN {hav('alat', 'alon', 'x.lat', 'x.lon')} > 5 THEN x.lon ELSE alon END,
    CASE WHEN {hav('alat', 'alon', 'x.lat', 'x.lon')} > 5 THEN w.k + 1 ELSE w.k END
  FROM walk w JOIN num x ON x.trip_id = w.trip_id AND x.n = w.n + 1),
runs AS (SELECT trip_id, k::BIGINT AS k, first(alat) AS lat, first(alon) AS lon, min(t) AS t_first, max(t) AS t_last, count(*) AS n, max(reported_speed) AS speed_max FROM walk JOIN num USING (trip_id, n) GROUP BY trip_id, k)"""
STALE = f"""{RUNS}, st0 AS (SELECT *, lead(t_first) OVER w AS nx, {hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} / 11 AS m FROM runs WINDOW w AS (PARTITION BY trip_id ORDER BY k)),
stale AS (SELECT *, coalesce(nx - t_last < m AND m <= nx - t_first, false) AS stale FROM st0)"""
LATTICE = f"""lt AS ({LATTICE_SQL.replace('{id}', 'range')}),
rec AS (SELECT *, from_lat_u / 1e6 AS alat, from_lon_u / 1e6 AS alon, to_lat_u / 1e6 AS blat, to_lon_u / 1e6 AS blon,
  0.0e0 + {hav('from_lat_u / 1e6', 'from_lon_u / 1e6', 'to_lat_u / 1e6', 'to_lon_u / 1e6')} AS length_m, {by_class(SPEED_CAPS, 40.0)} AS max_ms, {by_class(TYPICAL_SPEEDS, 8.0)} AS typ_ms FROM lt),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT from_node AS node_id FROM rec UNION ALL SELECT to_node FROM rec) GROUP BY node_id),
edge AS (SELECT e.*, t.link_id AS twin, df.degree AS deg_from, dt.degree AS deg_to, {azi('e.alat', 'e.alon', 'e.blat', 'e.blon')} AS dir FROM rec e LEFT JOIN rec t ON t.from_node = e.to_node AND t.to_node = e.from_node
  JOIN deg df ON df.node_id = e.from_node JOIN deg dt ON dt.node_id = e.to_node)"""


def projected(points: str, radius: float) -> str:
    """CTEs pr(…points, link_id, offset_m, perp_m) within the radius."""
    return f"""q0 AS (SELECT p.*, e.link_id, e.length_m, e.alat, e.alon, e.blon - e.alon AS dx, e.blat - e.alat AS dy FROM {points} p JOIN rec e
  ON p.lat BETWEEN least(e.alat, e.blat) - 0.005 AND greatest(e.alat, e.blat) + 0.005 AND p.lon BETWEEN least(e.alon, e.blon) - 0.005 AND greatest(e.alon, e.blon) + 0.005),
q1 AS (SELECT *, least(greatest(((lon - alon) * dx + (lat - alat) * dy) / (dx * dx + dy * dy), 0.0e0), 1.0e0) AS f FROM q0),
pr AS (SELECT *, f * length_m AS offset_m, {plane('lat', 'lon', '(alat + f * dy)', '(alon + f * dx)')} AS perp_m FROM q1 WHERE {plane('lat', 'lon', '(alat + f * dy)', '(alon + f * dx)')} <= {radius})"""


SNAP = f"""{CLEAN}, {LATTICE}, {projected('clean', 200.0)}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, seq ORDER BY perp_m, link_id) AS rn FROM pr) WHERE rn = 1),
snap AS (SELECT c.trip_id, c.seq AS k, b.link_id, b.perp_m FROM clean c LEFT JOIN best b ON b.trip_id = c.trip_id AND b.seq = c.seq)"""
TAGS = """tags AS (SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN ' 80 km/h ' WHEN 3 THEN 'none' WHEN 4 THEN '' WHEN 5 THEN '0' WHEN 6 THEN '60kmh' WHEN 7 THEN '7.5 mph' WHEN 8 THEN '50;30' WHEN 9 THEN '100 kph' WHEN 10 THEN 'MPH 30' END AS tag,
  CASE p_partkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'primary' WHEN 3 THEN 'living_street' WHEN 4 THEN 'footway' WHEN 5 THEN 'service' END AS road_class,
  CASE p_partkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' WHEN 3 THEN 'REVERSE' WHEN 4 THEN '1' WHEN 5 THEN 'maybe' WHEN 6 THEN '0' END AS oneway FROM part)"""
TRELLIS = """trips AS (SELECT DISTINCT user_id::BIGINT AS trip_id FROM events),
st AS (SELECT trip_id, k, i, -((trip_id * 31 + k * 17 + i * 7) % 100) AS e FROM trips, range(0, 6) a(k), range(0, 3) b(i)),
pc AS (SELECT trip_id, k, i, j, p AS path_id, -2 * ((trip_id * 13 + k * 29 + i * 5 + j * 11 + p * 41) % 97) AS lp FROM trips, range(0, 5) a(k), range(0, 3) b(i), range(0, 3) c(j), range(0, 2) d(p)
  WHERE (trip_id * 7 + k * 3 + i * 5 + j * 11 + p) % 6 <> 0 AND NOT (trip_id % 10 = 3 AND k = 2)),
cell AS (SELECT trip_id, k, i, j, max(lp) AS lp, sum(exp(lp / 64.0e0)) AS w FROM pc GROUP BY ALL)"""
ALPHA = (
    "a0 AS (SELECT trip_id, i, exp(e / 64.0e0) AS a FROM st WHERE k = 0), "
    + ", ".join(f"a{k + 1} AS (SELECT s.trip_id, s.i, exp(s.e / 64.0e0) * coalesce(sum(a.a * c.w), 0) AS a FROM st s LEFT JOIN cell c ON c.trip_id = s.trip_id AND c.k = {k} AND c.j = s.i LEFT JOIN a{k} a ON a.trip_id = s.trip_id AND a.i = c.i WHERE s.k = {k + 1} GROUP BY s.trip_id, s.i, s.e)" for k in range(5))
    + ", b5 AS (SELECT trip_id, i, 1.0e0 AS b FROM st WHERE k = 5), "
    + ", ".join(f"b{k} AS (SELECT s.trip_id, s.i, coalesce(sum(c.w * exp(n.e / 64.0e0) * b.b), 0) AS b FROM st s LEFT JOIN cell c ON c.trip_id = s.trip_id AND c.k = {k} AND c.i = s.i LEFT JOIN st n ON n.trip_id = s.trip_id AND n.k = {k + 1} AND n.i = c.j LEFT JOIN b{k + 1} b ON b.trip_id = s.trip_id AND b.i = c.j WHERE s.k = {k} GROUP BY s.trip_id, s.i)" for k in range(4, -1, -1))
    + ", al AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM a{k}" for k in range(6)) + "), be AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM b{k}" for k in range(6)) + "), z AS (SELECT trip_id, sum(a) AS z FROM a5 GROUP BY trip_id)"
)

# By trip and segment: chains of trips with 3 as last digit begin anew after k = 2.
ALPHA_ALL = (
    "a0 AS (SELECT trip_id, i, exp(e / 64.0e0) AS a FROM st WHERE k = 0), "
    + ", ".join(f"a{k + 1} AS (SELECT s.trip_id, s.i, exp(s.e / 64.0e0) * {'CASE WHEN s.trip_id % 10 = 3 THEN 1 ELSE coalesce(sum(a.a * c.w), 0) END' if k == 2 else 'coalesce(sum(a.a * c.w), 0)'} AS a FROM st s LEFT JOIN cell c ON c.trip_id = s.trip_id AND c.k = {k} AND c.j = s.i LEFT JOIN a{k} a ON a.trip_id = s.trip_id AND a.i = c.i WHERE s.k = {k + 1} GROUP BY s.trip_id, s.i, s.e)" for k in range(5))
    + ", b5 AS (SELECT trip_id, i, 1.0e0 AS b FROM st WHERE k = 5), "
    + ", ".join(f"b{k} AS (SELECT s.trip_id, s.i, {'CASE WHEN s.trip_id % 10 = 3 THEN 1 ELSE coalesce(sum(c.w * exp(n.e / 64.0e0) * b.b), 0) END' if k == 2 else 'coalesce(sum(c.w * exp(n.e / 64.0e0) * b.b), 0)'} AS b FROM st s LEFT JOIN cell c ON c.trip_id = s.trip_id AND c.k = {k} AND c.i = s.i LEFT JOIN st n ON n.trip_id = s.trip_id AND n.k = {k + 1} AND n.i = c.j LEFT JOIN b{k + 1} b ON b.trip_id = s.trip_id AND b.i = c.j WHERE s.k = {k} GROUP BY s.trip_id, s.i)" for k in range(4, -1, -1))
    + ", al AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM a{k}" for k in range(6)) + "), be AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM b{k}" for k in range(6))
    + "), z AS (SELECT trip_id, trip_id % 10 = 3 AS late, sum(a) AS z FROM a5 GROUP BY trip_id UNION ALL SELECT trip_id, false, sum(a) FROM a2 WHERE trip_id % 10 = 3 GROUP BY trip_id)"
)


def sequences(lo: int, hi: int) -> str:
    """All sequences of observations lo..hi: trip_id, s{lo}.., score."""
    cols = ", ".join(f"x{k}.i AS s{k}" for k in range(lo, hi + 1))
    joins = f"st x{lo}" + "".join(f" JOIN cell c{k} ON c{k}.trip_id = x{lo}.trip_id AND c{k}.k = {k} AND c{k}.i = x{k}.i JOIN st x{k + 1} ON x{k + 1}.trip_id = x{lo}.trip_id AND x{k + 1}.k = {k + 1} AND x{k + 1}.i = c{k}.j" for k in range(lo, hi))
    score = " + ".join([f"x{k}.e" for k in range(lo, hi + 1)] + [f"c{k}.lp" for k in range(lo, hi)])
    return f"SELECT x{lo}.trip_id, {cols}, {score} AS score FROM {joins} WHERE x{lo}.k = {lo}"


def best_of(lo: int, hi: int, seg: int, where: str) -> str:
    back = ", ".join(f"s{k}" for k in range(hi, lo - 1, -1))
    text = " || ',' || ".join(f"s{k}" for k in range(lo, hi + 1))
    return f"SELECT trip_id, {seg}::BIGINT AS seg, {lo}::BIGINT AS k_first, {text} AS states FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY score DESC, {back}) AS rn FROM ({sequences(lo, hi)})) WHERE rn = 1 AND {where}"


RECORDS = """r0 AS (SELECT (l_orderkey / 8)::BIGINT AS trip_id, l_orderkey % 5 AS k, l_linenumber::BIGINT AS path_id, max(l_partkey) AS p, max((l_partkey % 17 + 1)::DOUBLE) AS w FROM lineitem WHERE l_orderkey % 8 = 0 GROUP BY ALL),
rc AS (SELECT trip_id, k, path_id, w / sum(w) OVER (PARTITION BY trip_id, k) AS prob, list_distinct([(p % 4 + i * (1 + path_id % 2))::BIGINT FOR i IN range(0, 6)]) AS segs, [(trip_id % 4 + i)::BIGINT FOR i IN range(0, 6)] AS truth FROM r0),
rj AS (SELECT *, len(list_intersect(segs, truth)) AS hit, len(list_distinct(list_concat(segs, truth))) AS uni FROM rc)"""
RECORDS_ALL = RECORDS.replace("(l_orderkey / 8)::BIGINT", "l_orderkey::BIGINT").replace(" WHERE l_orderkey % 8 = 0", "")
EM = f"{RECORDS}, em AS (SELECT trip_id, k, s AS seg, least(sum(prob), 1.0e0) AS prob, bool_or(list_contains(truth, s)) AS on_truth FROM (SELECT *, unnest(segs) AS s FROM rc) GROUP BY trip_id, k, s)"
BINNED = f"{EM}, bins AS (SELECT ((round(prob, 9) >= 0.2)::INT + (round(prob, 9) >= 0.4)::INT + (round(prob, 9) >= 0.6)::INT + (round(prob, 9) >= 0.8)::INT)::BIGINT AS bin, count(*) AS n, avg(prob) AS stated, avg(on_truth::INT) AS observed FROM em GROUP BY 1)"

TWO = f"""{LATTICE}, two AS (SELECT a.link_id * 10000 + b.link_id AS path_id, a.link_id AS l1, b.link_id AS l2, a.road_class AS c1, b.road_class AS c2, a.length_m AS m1, b.length_m AS m2, a.dir AS d1, b.dir AS d2, a.deg_from, a.deg_to,
  least(a.from_node, a.to_node) || '-' || greatest(a.from_node, a.to_node) AS g1, least(b.from_node, b.to_node) || '-' || greatest(b.from_node, b.to_node) AS g2
  FROM edge a JOIN edge b ON b.from_node = a.to_node WHERE b.to_node <> a.from_node),
tw AS (SELECT *, path_id % 5 = 4 AS off, path_id % 3 <> 2 AS r1, path_id % 3 = 1 AS r2, path_id % 97 AS ett,
  CASE WHEN path_id % 3 <> 2 THEN (d1 + 180.0e0) % 360.0e0 ELSE d1 END AS out1, CASE WHEN path_id % 3 = 1 THEN (d2 + 180.0e0) % 360.0e0 ELSE d2 END AS in2 FROM two),
ft AS (SELECT *, ((in2 - out1 + 540.0e0) % 360.0e0) - 180.0e0 AS turn, CASE WHEN off THEN NULL WHEN g1 = g2 THEN g1 ELSE g1 || '>' || g2 END AS route FROM tw)"""


def share(slot: int) -> str:
    own = "(" + ", ".join(f"'{c}'" for c, s in CLASS_SLOTS.items() if s == slot) + ")"
    return f"round(CASE WHEN off THEN 0.5 * ((c1 IN {own})::INT + (c2 IN {own})::INT) ELSE (CASE WHEN c1 IN {own} THEN m1 ELSE 0 END + CASE WHEN c2 IN {own} THEN m2 ELSE 0 END) / (m1 + m2) END, 6)::DOUBLE AS phi_{slot:02d}"


def at_time(rule: str) -> str:
    part = {"front": "CASE WHEN tau <= 60 - ett THEN 0.0e0 ELSE (tau - (60 - ett)) / ett::DOUBLE END", "back": "CASE WHEN tau >= ett THEN 1.0e0 ELSE tau / ett::DOUBLE END", "spread": "tau / 60.0e0"}[rule]
    return f"""WITH {LATTICE}, x AS (SELECT a.link_id * 10000 + b.link_id AS id, a.link_id AS l1, b.link_id AS l2, a.length_m AS m1, b.length_m AS m2, (a.link_id * 10000 + b.link_id) % 60 AS tau, (a.link_id * 10000 + b.link_id) % 41 AS ett FROM rec a JOIN rec b ON b.from_node = a.to_node WHERE b.to_node <> a.from_node),
y AS (SELECT *, CASE WHEN ett <= 0 THEN 0.0e0 ELSE least(greatest({part}, 0), 1) END * ((m1 - m1 * 0.25e0) + m2 * 0.5e0) AS d FROM x)
SELECT id, CASE WHEN d <= m1 - m1 * 0.25e0 THEN l1 ELSE l2 END AS link_id, round(CASE WHEN d <= m1 - m1 * 0.25e0 THEN m1 * 0.25e0 + d ELSE least(d - (m1 - m1 * 0.25e0), m2 * 0.5e0) END, 6) AS offset_m FROM y"""


def sql() -> dict[str, str]:
    nu, s = 4.0, 10.0
    norm = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s)
    speed = "nullif(regexp_extract(tag, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(km/h|kmh|kph|mph)?\\s*$', 1), '')::DOUBLE"
    unit = "regexp_extract(tag, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(km/h|kmh|kph|mph)?\\s*$', 2)"
    hop = f"WITH {CLEAN}, h AS (SELECT *, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM clean WINDOW w AS (PARTITION BY trip_id ORDER BY seq))"
    x = ("lat", "lon", "la", "lo")
    h = lambda a, b: hav(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")
    pad, mid = 300 / 111320, math.cos(math.radians((41.141 + 41.1495) / 2))
    out = {
        "porto_explode": f"WITH {PINGS} SELECT trip_id::VARCHAR AS trip_id, seq, (1704067200 + trip_id + 15 * seq)::BIGINT AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pings WHERE seq < 12 AND trip_id % 11 <> 0 AND trip_id % 13 <> 0 AND seq % 7 <> 3 QUALIFY count(*) OVER (PARTITION BY trip_id) >= 2",
        "geo_functions": f"{hop} SELECT trip_id, seq, round({hav(*x)}, 6) AS haversine_m, round({azi(*x)}, 6) AS azimuth_deg, round({plane(*x)}, 6) AS plane_m FROM h WHERE la IS NOT NULL",
        "maxspeed_parse": f"WITH {TAGS}, s AS (SELECT *, CASE WHEN {unit} = 'mph' THEN {speed} * 1609.344e0 / 3600 ELSE {speed} / 3.6e0 END AS v, {by_class(SPEED_CAPS, 40.0)} AS cap_ms, {by_class(TYPICAL_SPEEDS, 8.0)} AS typ_ms FROM tags) SELECT p_partkey, round(CASE WHEN v > 0 THEN v ELSE cap_ms END, 6) AS max_ms, cap_ms, typ_ms FROM s",
        "oneway_resolve": f"WITH {TAGS}, d AS (SELECT p_partkey, CASE WHEN oneway IS NULL THEN (CASE WHEN road_class IN ('motorway', 'motorway_link') THEN 'f' ELSE 'b' END) WHEN lower(oneway) IN ('-1', 'reverse') THEN 'r' WHEN lower(oneway) IN ('yes', 'true', '1') THEN 'f' ELSE 'b' END AS d FROM tags) SELECT p_partkey, d IN ('f', 'b') AS forward, d IN ('r', 'b') AS backward FROM d",
        "clean_pings": f"WITH {CLEAN} SELECT trip_id, seq, t::BIGINT AS t, lat, lon FROM clean",
        "spike_removal": f"""WITH RECURSIVE {CLEAN}, jump AS (SELECT a.trip_id, a.n, min(z.n) AS j FROM num a JOIN num b ON b.trip_id = a.trip_id AND b.n = a.n + 1 JOIN num z ON z.trip_id = a.trip_id AND z.n BETWEEN a.n + 2 AND a.n + 4 JOIN num y ON y.trip_id = a.trip_id AND y.n = z.n - 1
  WHERE {h('a', 'b')} / (b.t - a.t) > 150 AND {h('y', 'z')} / (z.t - y.t) > 150 AND {h('a', 'z')} / (z.t - a.t) <= 100 GROUP BY a.trip_id, a.n),
visit AS (SELECT trip_id, 0::BIGINT AS n FROM num WHERE n = 0 UNION ALL SELECT v.trip_id, coalesce(j.j, v.n + 1) FROM visit v JOIN num x ON x.trip_id = v.trip_id AND x.n = v.n LEFT JOIN jump j ON j.trip_id = v.trip_id AND j.n = v.n)
SELECT trip_id, seq FROM num JOIN visit USING (trip_id, n)""",
        "collapse_runs": f"WITH RECURSIVE {RUNS} SELECT trip_id, k, lat, lon, t_first::BIGINT AS t_first, t_last::BIGINT AS t_last, n, speed_max FROM runs",
        "stale_runs": f"WITH RECURSIVE {STALE} SELECT trip_id, k, stale FROM stale",
        "replay_bursts": f"""WITH RECURSIVE {STALE}, c0 AS (SELECT *, (n <= 1 OR speed_max IS NULL OR speed_max < 20) AS own, coalesce(t_first > lag(t_first) OVER w AND {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} <= 12 * (t_first - lag(t_first) OVER w), false) AS ok FROM stale WINDOW w AS (PARTITION BY trip_id ORDER BY k)),
c1 AS (SELECT *, own AND coalesce(lead(own) OVER w AND lead(ok) OVER w, false) AS chain FROM c0 WINDOW w AS (PARTITION BY trip_id ORDER BY k)),
c2 AS (SELECT *, max(CASE WHEN stale THEN k END) OVER (PARTITION BY trip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls, max(CASE WHEN chain THEN k END) OVER (PARTITION BY trip_id ORDER BY k) AS lc, min(CASE WHEN chain THEN k END) OVER (PARTITION BY trip_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nc FROM c1)
SELECT trip_id, k, stale, ls IS NOT NULL AND nc IS NOT NULL AND (lc IS NULL OR lc <= ls) AS replayed FROM c2""",
        "time_budgets": f"WITH RECURSIVE {STALE}, d AS (SELECT *, CASE WHEN stale THEN 0 ELSE t_last - t_first END AS dwell_s FROM stale) SELECT trip_id, k, dwell_s, nx - t_first - dwell_s AS budget_s FROM d",
        "thin_stride": f"WITH {PINGS}, s AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS c FROM pings) SELECT trip_id, seq FROM s WHERE i % 8 = 0 OR i = c - 1",
        "thin_time": f"WITH RECURSIVE {CLEAN}, w AS (SELECT trip_id, n, t AS last, true AS kept FROM num WHERE n = 0 UNION ALL SELECT x.trip_id, x.n, CASE WHEN x.t - last >= 50 THEN x.t ELSE last END, x.t - last >= 50 FROM w JOIN num x ON x.trip_id = w.trip_id AND x.n = w.n + 1) SELECT trip_id, seq FROM w JOIN num USING (trip_id, n) WHERE kept",
        "network_build": f"WITH {LATTICE} SELECT link_id, road_class, from_node, to_node, round(length_m, 6) AS length_m, max_ms, typ_ms, to_node % 5 = 0 AS signal, to_node % 5 <> 0 AND to_node % 7 = 0 AS stop, deg_from, deg_to, round(dir, 6) AS entry_deg, round(dir, 6) AS exit_deg, least(from_node, to_node) AS lo, greatest(from_node, to_node) AS hi, twin FROM edge",
        "node_table": f"WITH {LATTICE}, adj AS (SELECT from_node AS node_id, string_agg(link_id::VARCHAR, ',' ORDER BY link_id) AS links FROM rec GROUP BY 1) SELECT node_id, degree, round((41130000 + (node_id // 21) * 2000) / 1e6, 6) AS lat, round((-8630000 + (node_id % 21) * 2000) / 1e6, 6) AS lon, links FROM deg LEFT JOIN adj USING (node_id)",
        "bbox_subgraph": f"WITH {LATTICE}, s AS (SELECT link_id, from_node, to_node FROM rec WHERE greatest(alat, blat) >= {41.141 - pad!r} AND least(alat, blat) <= {41.1495 + pad!r} AND greatest(alon, blon) >= {-8.6195 - pad / mid!r} AND least(alon, blon) <= {-8.611 + pad / mid!r}), d AS (SELECT node_id, count(*) AS c FROM (SELECT from_node AS node_id FROM s UNION ALL SELECT to_node FROM s) GROUP BY 1) SELECT link_id, f.c AS deg_from, t.c AS deg_to FROM s JOIN d f ON f.node_id = from_node JOIN d t ON t.node_id = to_node",
        "project_topk": f"WITH {CLEAN}, {LATTICE}, {projected('clean', 100.0)} SELECT trip_id, seq, row_number() OVER (PARTITION BY trip_id, seq ORDER BY perp_m, link_id) - 1 AS rank, link_id, round(offset_m, 6) AS offset_m, round(perp_m, 6) AS perp_m FROM pr QUALIFY rank < 4",
        "project_widening": f"WITH {CLEAN}, {LATTICE}, {projected('clean', 80.0)}, g AS (SELECT *, min(perp_m) OVER (PARTITION BY trip_id, seq) AS m FROM pr), k AS (SELECT * FROM g WHERE perp_m <= CASE WHEN m <= 10 THEN 10 WHEN m <= 20 THEN 20 WHEN m <= 40 THEN 40 ELSE 80 END) SELECT trip_id, seq, row_number() OVER (PARTITION BY trip_id, seq ORDER BY perp_m, link_id) - 1 AS rank, link_id, round(perp_m, 6) AS perp_m FROM k QUALIFY rank < 3",
        "permissive_arcs": f"WITH {LATTICE} SELECT from_node AS u, to_node AS v, link_id, round(length_m / typ_ms, 6) AS weight, round(length_m / max_ms, 6) AS fastest, false AS illegal FROM edge UNION ALL SELECT to_node, from_node, link_id, round(length_m / typ_ms * 3, 6), round(length_m / max_ms, 6), true FROM edge WHERE twin IS NULL",
        "shortest_time": f"WITH RECURSIVE {LATTICE}, w AS (SELECT from_node, to_node, ceil(length_m / max_ms)::BIGINT AS c FROM rec), dist(node, t) USING KEY (node) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT n.node, n.t FROM (SELECT w.to_node AS node, min(d.t + w.c)::BIGINT AS t FROM dist d JOIN w ON w.from_node = d.node GROUP BY w.to_node) n LEFT JOIN recurring.dist o ON o.node = n.node WHERE o.t IS NULL OR n.t < o.t) SELECT 0::BIGINT AS from_node, node AS to_node, t AS time_s FROM dist",
        "path_features": f"WITH {TWO} SELECT path_id, route, round((m1 + m2) / 1000, 6) AS phi_00, (CASE WHEN NOT off AND turn <= -30 THEN 1 ELSE 0 END)::DOUBLE AS phi_01, (CASE WHEN NOT off AND turn >= 30 THEN 1 ELSE 0 END)::DOUBLE AS phi_02, 0.0e0 AS phi_03, 0.0e0 AS phi_04, {', '.join(share(i) for i in range(5, 12))}, round(ett / 60.0e0, 6) AS phi_12, round(greatest(60 - ett, 0) / 60.0e0, 6) AS phi_13, round(greatest(60 - ett, 0) / 60.0e0, 6) AS phi_14, round((path_id % 9) / 10.0e0, 6) AS phi_15, 0.2e0 AS phi_16, (CASE WHEN NOT off AND (CASE WHEN r1 THEN deg_from ELSE deg_to END) >= 3 THEN 1 ELSE 0 END)::DOUBLE AS phi_17, (CASE WHEN off THEN 0 WHEN r1 THEN 1 ELSE 0 END)::DOUBLE AS phi_18 FROM ft",
        "route_diverse_topk": f"WITH {TWO}, g AS (SELECT *, l1 % 40 AS g, CASE WHEN route IS NULL THEN 0 WHEN row_number() OVER (PARTITION BY l1 % 40, route ORDER BY ett, path_id) = 1 THEN 0 ELSE 1 END AS r FROM ft) SELECT g, path_id, row_number() OVER (PARTITION BY g ORDER BY r, ett, path_id) AS place FROM g QUALIFY place <= 10",
        "emission_logpdf": f"WITH {CLEAN}, {LATTICE}, f AS (SELECT * FROM clean WHERE seq < 10), {projected('f', 60.0)} SELECT trip_id, seq, link_id, round({norm!r} - 2.5e0 * ln(1 + pow(perp_m / 10.0e0, 2) / 4.0e0), 6) AS log_e, round(-1 + 5.0e0 * perp_m * perp_m / (400.0e0 + perp_m * perp_m), 6) AS slope FROM pr",
        "cell_scores": f"WITH {TRELLIS} SELECT trip_id, k, i::INT AS i, j::INT AS j, round(ln(sum(exp(lp / 64.0e0))), 6) AS log_sum, round(max(lp) / 64.0e0, 6) AS log_max, arg_max(path_id, lp * 10 - path_id) AS best_path FROM pc GROUP BY ALL",
        "viterbi_mle": f"WITH {TRELLIS} {best_of(0, 5, 0, 'trip_id % 10 <> 3')} UNION ALL {best_of(0, 2, 0, 'trip_id % 10 = 3')} UNION ALL {best_of(3, 5, 1, 'trip_id % 10 = 3')}",
        "forward_backward": f"WITH {TRELLIS}, {ALPHA} SELECT al.trip_id, al.k::BIGINT AS k, al.i::INT AS i, round(a * b / z, 6) AS prob, round(ln(z), 6) AS log_z FROM al JOIN be ON be.trip_id = al.trip_id AND be.k = al.k AND be.i = al.i JOIN z ON z.trip_id = al.trip_id WHERE al.trip_id % 10 <> 3",
        "path_marginals": f"WITH {TRELLIS}, {ALPHA} SELECT pc.trip_id, pc.k, pc.path_id + 10 * pc.i + 100 * pc.j AS path_id, round(a * exp(lp / 64.0e0) * exp(st.e / 64.0e0) * b / z, 6) AS prob FROM pc JOIN al ON al.trip_id = pc.trip_id AND al.k = pc.k AND al.i = pc.i JOIN be ON be.trip_id = pc.trip_id AND be.k = pc.k + 1 AND be.i = pc.j JOIN st ON st.trip_id = pc.trip_id AND st.k = pc.k + 1 AND st.i = pc.j JOIN z ON z.trip_id = pc.trip_id WHERE pc.trip_id % 10 <> 3",
        "topk_viterbi": f"WITH {TRELLIS} SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY score DESC) AS place, round(score / 64.0e0, 6) AS score FROM ({sequences(0, 5)}) QUALIFY place <= 6",
        "snap_baseline": f"WITH {SNAP} SELECT trip_id, k, link_id, round(perp_m, 6) AS perp_m FROM snap",
        "edge_disagreement": f"WITH {SNAP} SELECT trip_id, round(coalesce(avg(CASE WHEN link_id IS NULL OR k % 9 = 0 THEN NULL WHEN k % 4 = 0 THEN 1.0 ELSE 0.0 END), 0), 6)::DOUBLE AS rate FROM snap GROUP BY trip_id",
        "path_scores": f"WITH {RECORDS}, b AS (SELECT *, row_number() OVER (PARTITION BY trip_id, k ORDER BY hit / uni DESC, len(segs), path_id) AS rn, sum(-prob * ln(prob)) OVER (PARTITION BY trip_id, k) AS entropy FROM rj) SELECT trip_id, k, round((len(truth) - hit) / len(truth), 6) AS miss_rate, round(hit / uni, 6) AS best_jaccard, path_id AS best_path, round(entropy, 6) AS entropy FROM b WHERE rn = 1",
        "topk_rank": f"WITH {RECORDS}, w AS (SELECT *, hit = uni AS same, row_number() OVER (PARTITION BY trip_id, k ORDER BY prob DESC, path_id) AS n, coalesce(sum(prob) OVER (PARTITION BY trip_id, k ORDER BY prob DESC, path_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rj) SELECT trip_id, k, min(CASE WHEN same THEN n END) AS truth_rank, coalesce(bool_or(CASE WHEN same THEN before < 0.9e0 - 1e-12 END), false) AS covered FROM w GROUP BY trip_id, k",
        "edge_marginals": f"WITH {EM} SELECT trip_id, k, seg, round(prob, 6) AS prob, on_truth FROM em",
        "calibration_bins": f"WITH {BINNED} SELECT bin, n, round(stated, 6) AS stated, round(observed, 6) AS observed FROM bins",
        "calibration_error": f"WITH {BINNED} SELECT round(100 * sum(n * abs(stated - observed)) / sum(n), 6) AS ece FROM bins",
        "cluster_paths": f"WITH RECURSIVE {RECORDS}, l AS (SELECT a.trip_id, a.k, a.path_id AS a, b.path_id AS b FROM rc a JOIN rc b ON b.trip_id = a.trip_id AND b.k = a.k WHERE 1 - len(list_intersect(a.segs, b.segs)) / len(list_distinct(list_concat(a.segs, b.segs)))::DOUBLE <= 0.4e0), r AS (SELECT trip_id, k, a, b FROM l UNION SELECT r.trip_id, r.k, r.a, l.b FROM r JOIN l ON l.trip_id = r.trip_id AND l.k = r.k AND l.a = r.b) SELECT trip_id, k, a AS path_id, min(b) AS cluster FROM r GROUP BY trip_id, k, a",
        "diversity_filter": f"""WITH RECURSIVE {RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY trip_id, k ORDER BY prob DESC, path_id) AS n FROM rc),
g AS (SELECT trip_id, k, n, path_id, [segs] AS taken, true AS ok FROM o WHERE n = 1
  UNION ALL SELECT o.trip_id, o.k, o.n, o.path_id, CASE WHEN t.ok THEN list_append(g.taken, o.segs) ELSE g.taken END, t.ok FROM g JOIN o ON o.trip_id = g.trip_id AND o.k = g.k AND o.n = g.n + 1,
  LATERAL (SELECT len(g.taken) < 5 AND len(list_filter(g.taken, lambda s: 1 - len(list_intersect(s, o.segs)) / len(list_distinct(list_concat(s, o.segs)))::DOUBLE < 0.5e0)) = 0 AS ok) t)
SELECT trip_id, k, path_id, len(taken) AS place FROM g WHERE ok""",
        "overlap_dwell": f"WITH RECURSIVE {RUNS}, b AS (SELECT trip_id, min(t_first) AS t0, max(t_last) AS t1 FROM runs GROUP BY trip_id), w AS (SELECT trip_id, i AS w, t0 + 120 * i AS lo, t0 + 120 * (i + 1) AS hi FROM b, range(0, 100000) r(i) WHERE i <= floor((t1 - t0) / 120)) SELECT w.trip_id, w.w, round(coalesce(sum(t_last - t_first), 0), 6)::DOUBLE AS dwell_s FROM w LEFT JOIN runs r ON r.trip_id = w.trip_id AND r.t_first < w.hi AND r.t_last > w.lo GROUP BY w.trip_id, w.w",
        "nearest_truth": f"WITH {CLEAN} SELECT a.trip_id, a.seq, arg_min(b.seq, abs(b.t - a.t) * 1e9 + b.seq) AS value FROM clean a LEFT JOIN clean b ON b.trip_id = a.trip_id AND b.seq % 3 = 0 WHERE a.seq % 3 <> 0 GROUP BY a.trip_id, a.seq",
        "rule_errors": f"WITH {PINGS}, e AS (SELECT trip_id, (seq * 7 % 13 + 1)::DOUBLE AS f, (seq * 5 % 11 + 1)::DOUBLE AS b, (seq * 3 % 17 + 1)::DOUBLE AS s FROM pings WHERE lat <> 0) SELECT trip_id, count(*) AS n, median(f) AS front_median, median(b) AS back_median, median(s) AS spread_median, median(least(f, b, s)) AS oracle_median, round(quantile_cont(least(f, b, s), 0.95), 6) AS oracle_p95, count(*) FILTER (f = least(f, b, s)) AS front_wins FROM e GROUP BY trip_id",
        "sampling_stats": f"{hop}, d AS (SELECT trip_id, {hav(*x)} AS d FROM h WHERE la IS NOT NULL) SELECT trip_id, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max FROM d GROUP BY trip_id",
        "segment_islands": f"WITH {CLEAN}, s AS (SELECT trip_id, seq AS k FROM clean WHERE seq % 7 <> 5), n AS (SELECT s.*, coalesce(k - lag(k) OVER (PARTITION BY trip_id ORDER BY k) <> 1, true) OR NOT EXISTS (SELECT 1 FROM clean c WHERE c.trip_id = s.trip_id AND c.seq = s.k - 1 AND c.seq % 11 <> 9) AS new FROM s) SELECT trip_id, k, (sum(new::INT) OVER (PARTITION BY trip_id ORDER BY k) - 1)::BIGINT AS island FROM n",
    }
    for name in ("path_scores", "topk_rank", "edge_marginals", "calibration_bins", "calibration_error", "cluster_paths", "diversity_filter"):
        out[f"{name}_all"] = out[name].replace(RECORDS, RECORDS_ALL)
    out["emission_logpdf_all"] = out["emission_logpdf"].replace(" WHERE seq < 10", "")
    out["porto_explode_all"] = out["porto_explode"].replace("seq < 12 AND ", "")
    out["forward_backward_all"] = f"WITH {TRELLIS}, {ALPHA_ALL} SELECT al.trip_id, al.k::BIGINT AS k, al.i::INT AS i, round(a * b / z, 6) AS prob, round(ln(z), 6) AS log_z FROM al JOIN be ON be.trip_id = al.trip_id AND be.k = al.k AND be.i = al.i JOIN z ON z.trip_id = al.trip_id AND z.late = (al.trip_id % 10 = 3 AND al.k > 2)"
    out["path_marginals_all"] = f"WITH {TRELLIS}, {ALPHA_ALL} SELECT pc.trip_id, pc.k, pc.path_id + 10 * pc.i + 100 * pc.j AS path_id, round(a * exp(lp / 64.0e0) * exp(st.e / 64.0e0) * b / z, 6) AS prob FROM pc JOIN al ON al.trip_id = pc.trip_id AND al.k = pc.k AND al.i = pc.i JOIN be ON be.trip_id = pc.trip_id AND be.k = pc.k + 1 AND be.i = pc.j JOIN st ON st.trip_id = pc.trip_id AND st.k = pc.k + 1 AND st.i = pc.j JOIN z ON z.trip_id = pc.trip_id AND z.late = (pc.trip_id % 10 = 3 AND pc.k > 2)"
    return out | {f"at_time_{r}": at_time(r) for r in ("front", "back", "spread")}
