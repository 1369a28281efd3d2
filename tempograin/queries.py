"""A query for each operator over the test tables, and the SQL that says what it must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.functions import decimals, intervals, tags
from tempograin.functions.grid import Width, bucket_index, bucket_start, convert_distance, epoch, instant, moment, panel_width, rfc3339, units_between
from tempograin.operators import compress as cp
from tempograin.operators import detect, joins, reads, shapes, signals, similarity, sketch
from tempograin.operators.chunks import neighbours
from tempograin.operators.fill import fill
from tempograin.operators.interpolate import interpolate, interpolate_point, knots_of
from tempograin.operators.reduce import coarsen, downsample, finish, merge, partials, rebucket
from tempograin.plans.analysis import Analysis
from tempograin.plans.rollup import Rollups, StoredRollups
from tempograin.plans.scratch import fresh
from tempograin.sources import formats, ilp
from tempograin.sources.store import Aspect, Store
from tempograin.streaming import ingest as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: 2024-01-01, the first day of the events.
BEGIN = 1_704_067_200_000_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare across engines."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`") for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "event_type", "user_id", epoch("ts").alias("ts"), F.col("value").cast("decimal(18,2)").alias("value"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping, unsorted segments: instants cut to hours, three seals, and nulls among the values."""
    e = events(spark, sf_dir)
    value = F.when(F.col("seq") % 17 != 0, F.col("value"))
    return e.select(F.lit("event_value").alias("aspect"), F.col("event_type").alias("series_key"), (F.col("ts") - F.pmod("ts", F.lit(HOUR))).alias("ts"), value.alias("value"), (F.col("seq") % 3).alias("seal_seq"), F.col("seq").alias("row_seq"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by event type and hour, as a series."""
    return downsample(events(spark, sf_dir), "1h", ["avg"], ["event_type"]).select("event_type", F.col("bucket").alias("ts"), F.col("avg").alias("value"))


EV = "ev AS (SELECT event_id AS seq, event_type, user_id, epoch_us(ts) AS ts, value::DECIMAL(18,2) AS value FROM events)"
ST = f"st AS (SELECT event_type AS series_key, epoch_us(ts) - epoch_us(ts) % {HOUR} AS ts, CASE WHEN event_id % 17 <> 0 THEN value::DECIMAL(18,2) END AS value, event_id % 3 AS seal_seq, event_id AS row_seq FROM events)"
HR = f"{EV}, hr AS (SELECT event_type, ts - ts % {HOUR} AS ts, sum(value)::DOUBLE / count(*) AS value FROM ev GROUP BY ALL)"
BASIC = "count(*) AS count, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, sum(value)::DOUBLE AS sum, sum(value)::DOUBLE / count(*) AS avg, first(value ORDER BY ts, seq)::DOUBLE AS first, last(value ORDER BY ts, seq)::DOUBLE AS last"
ALL_SIX = ("min", "max", "sum", "avg", "first", "last")


def by(width: int, what: str = BASIC, where: str = "true") -> str:
    return f"WITH {EV} SELECT event_type, ts - ts % {width} AS bucket, {what} FROM ev WHERE {where} GROUP BY ALL"


# Downsampling.
@query(by(HOUR))
def downsample_hours(spark, sf):
    return downsample(events(spark, sf), "hours", ALL_SIX, ["event_type"])


@query(by(900_000_000, where=f"ts BETWEEN {BEGIN + DAY} AND {BEGIN + 9 * DAY}"))
def downsample_width_range(spark, sf):
    return downsample(events(spark, sf), "15m", ALL_SIX, ["event_type"], BEGIN + DAY, BEGIN + 9 * DAY)


@query(by(30 * DAY))
def downsample_months(spark, sf):
    return downsample(events(spark, sf), "1mo", ALL_SIX, ["event_type"])


@query(f"SELECT epoch_us(o_orderdate) - epoch_us(o_orderdate) % {7 * DAY} AS bucket, o_orderpriority, count(*) AS count, min(o_totalprice::DECIMAL(18,2))::DOUBLE AS min, max(o_totalprice::DECIMAL(18,2))::DOUBLE AS max, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS sum FROM orders GROUP BY ALL")
def downsample_orders_weekly(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", epoch("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    return downsample(o, "1w", ["min", "max", "sum"], ["o_orderpriority"])


@query(by(6 * HOUR, "count(*) AS count, " + ", ".join(f"list_sort(list(value))[(count(*) * {r} + 99) // 100]::DOUBLE AS p{r}" for r in (50, 90, 95, 99))))
def downsample_percentiles(spark, sf):
    return downsample(events(spark, sf), "6h", ["p50", "p90", "p95", "p99"], ["event_type"])


@query(f"""WITH {EV}, x AS (
  SELECT *, ts - ts % {HOUR} AS bucket, lead(ts) OVER w AS nt, lead(value) OVER w AS nv FROM ev WINDOW w AS (PARTITION BY event_type, ts - ts % {HOUR} ORDER BY ts, seq)
), y AS (SELECT *, (nt - ts) // 1000 AS dt, (coalesce(nt, bucket + {HOUR}) - ts) // 1000 AS de FROM x)
SELECT event_type, bucket, count(*) AS count,
  CASE WHEN coalesce(sum(dt), 0) = 0 THEN sum(value)::DOUBLE / count(*) ELSE sum(value * dt::DECIMAL(18,0))::DOUBLE / sum(dt)::DOUBLE END AS twa,
  CASE WHEN coalesce(sum(dt), 0) = 0 THEN sum(value)::DOUBLE / count(*) ELSE sum((value + nv) * dt::DECIMAL(17,0))::DOUBLE / (sum(dt)::DOUBLE * 2) END AS twa_linear,
  CASE WHEN coalesce(sum(de), 0) = 0 THEN sum(value)::DOUBLE / count(*) ELSE sum(value * de::DECIMAL(18,0))::DOUBLE / sum(de)::DOUBLE END AS twa_bucket_end
FROM y GROUP BY ALL""")
def downsample_time_weighted(spark, sf):
    return downsample(events(spark, sf), "1h", ["twa", "twa_linear", "twa_bucket_end"], ["event_type"])


def sketch_sql(group: str, source: str, quantiles: dict[str, float], most: int) -> str:
    g = "ln(1.01 / 0.99)"
    rank = ", ".join(f"min(CASE WHEN upto >= greatest(1, ceil({q}::DOUBLE * total)) THEN o END) AS {a}" for a, q in quantiles.items())
    value = lambda a: f"CASE WHEN {a}.sign = 0 THEN 0 ELSE round({a}.sign * 2 * pow(1.01 / 0.99, ({a}.sign * {a}.o)::DOUBLE) / (1.01 / 0.99 + 1), 6) END AS {a}"
    return f"""b AS (SELECT {group}, sign(v)::INT AS sign, CASE WHEN v = 0 THEN 0 ELSE ceil(ln(abs(v)) / {g})::BIGINT END AS idx, count(*) AS n FROM {source} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {group}, sign ORDER BY idx DESC) AS k FROM b),
l AS (SELECT *, max(CASE WHEN k = {most} THEN idx END) OVER (PARTITION BY {group}, sign) AS low FROM r),
c AS (SELECT {group}, sign, greatest(idx, low) AS idx, sum(n) AS n FROM l GROUP BY ALL),
u AS (SELECT *, {{'sign': sign, 'o': sign * idx}} AS o, sum(n) OVER (PARTITION BY {group} ORDER BY sign, sign * idx) AS upto, sum(n) OVER (PARTITION BY {group}) AS total FROM c),
q AS (SELECT {group}, {rank} FROM u GROUP BY ALL)
SELECT {group}, {', '.join(value(a) for a in quantiles)} FROM q"""


QUANTILES = {"sketch_p50": 0.50, "sketch_p90": 0.90, "sketch_p95": 0.95, "sketch_p99": 0.99}


@query(f"WITH {EV}, s AS (SELECT event_type, ts - ts % {DAY} AS bucket, value::DOUBLE AS v FROM ev), " + sketch_sql("event_type, bucket", "s", QUANTILES, 2048))
def downsample_sketches(spark, sf):
    d = downsample(events(spark, sf), "1d", list(QUANTILES), ["event_type"]).drop("count")
    return d.select("event_type", "bucket", *[F.round(a, 6).alias(a) for a in QUANTILES])


@query("WITH s AS (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem), " + sketch_sql("flag", "s", {"q10": 0.1, "q50": 0.5}, 100))
def sketch_lowest_collapsed(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"))
    out = sketch.sketch_quantiles(d, ["flag"], {"q10": 0.1, "q50": 0.5}, most=100)
    return out.select("flag", F.round("q10", 6).alias("q10"), F.round("q50", 6).alias("q50"))


@query("""WITH b AS (SELECT l_returnflag AS flag, ceil(ln(l_extendedprice) / ln(1.01 / 0.99))::BIGINT AS idx, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT flag, k FROM (SELECT flag, k, count(DISTINCT ceil(idx / pow(2, k))) AS m FROM b, range(0, 13) t(k) GROUP BY ALL) WHERE m <= 64 QUALIFY row_number() OVER (PARTITION BY flag ORDER BY k) = 1),
c AS (SELECT flag, k, ceil(idx / pow(2, k))::BIGINT AS idx, sum(n) AS n FROM b JOIN k USING (flag) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY flag ORDER BY idx) AS upto, sum(n) OVER (PARTITION BY flag) AS total FROM c)
SELECT flag, k::INT AS collapses, round(tanh(pow(2, k) * atanh(0.01)), 9) AS accuracy,
  round(2 * pow(pow(1.01 / 0.99, pow(2, k)), min(CASE WHEN upto >= ceil(0.5::DOUBLE * total) THEN idx END)::DOUBLE) / (pow(1.01 / 0.99, pow(2, k)) + 1), 4) AS q50
FROM u GROUP BY flag, k""")
def sketch_uniform_collapse(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"))
    out = sketch.uniform_quantiles(d, ["flag"], {"q50": 0.5}, most=64)
    return out.select("flag", "collapses", F.round("accuracy", 9).alias("accuracy"), F.round("q50", 4).alias("q50"))


@query("WITH s AS (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem), b AS (SELECT flag, sign(v)::INT AS sign, ceil(ln(abs(v)) / ln(1.01 / 0.99))::BIGINT AS idx, count(*) AS n FROM s WHERE v <> 0 GROUP BY ALL) SELECT * FROM b")
def sketch_merged(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"), F.pmod("l_orderkey", F.lit(4)).alias("part"))
    return sketch.merge_bins(sketch.bins(d, ["flag", "part"]).drop("part"), ["flag"])


#: One event type unknown: a null group is a group like any other.
NULLED = "ev AS (SELECT event_id AS seq, nullif(event_type, 'click') AS event_type, epoch_us(ts) AS ts, value::DECIMAL(18,2) AS value FROM events)"


def nulled(spark, sf):
    return events(spark, sf).withColumn("event_type", F.nullif(F.col("event_type"), F.lit("click")))


@query(f"WITH {NULLED}, s AS (SELECT event_type, ts - ts % {DAY} AS bucket, value::DOUBLE AS v FROM ev), z AS ({'WITH ' + sketch_sql('event_type, bucket', 's', QUANTILES, 2048)}), x AS (SELECT event_type, ts - ts % {DAY} AS bucket, count(*) AS count, list_sort(list(value))[(count(*) * 50 + 99) // 100]::DOUBLE AS p50 FROM ev GROUP BY ALL) SELECT x.*, z.sketch_p50 FROM x JOIN z ON x.event_type IS NOT DISTINCT FROM z.event_type AND x.bucket = z.bucket")
def downsample_null_group(spark, sf):
    return downsample(nulled(spark, sf), "1d", ["p50", "sketch_p50"], ["event_type"]).withColumn("sketch_p50", F.round("sketch_p50", 6))


# Partial reductions.
@query(by(HOUR))
def partials_merged(spark, sf):
    e = events(spark, sf)
    a, b = (partials(e.where(F.col("seq") % 2 == k), "1h", ["event_type"]) for k in (0, 1))
    return finish(merge(a.unionByName(b), ["event_type"]), "1h", ALL_SIX, ["event_type"])


@query(by(5 * HOUR))
def partials_coarsened(spark, sf):
    return finish(coarsen(partials(events(spark, sf), "1h", ["event_type"]), 5, ["event_type"]), "5h", ALL_SIX, ["event_type"])


@query(by(DAY))
def partials_rebucketed(spark, sf):
    return finish(rebucket(partials(events(spark, sf), "1h", ["event_type"]), "1h", "1d", ["event_type"]), "1d", ALL_SIX, ["event_type"])


@query(by(DAY, where=f"ts >= {BEGIN + 2 * DAY} AND ts < {BEGIN + 20 * DAY}"))
def rollup_substituted(spark, sf):
    e = events(spark, sf)
    return Rollups(["event_type"]).materialize(e, "1h", ["6h"]).downsample(e, "1d", ALL_SIX, BEGIN + 2 * DAY, BEGIN + 20 * DAY - 1)


@query(f"WITH {EV}, s AS (SELECT event_type, ts - ts % {DAY} AS bucket, value::DOUBLE AS v FROM ev), z AS ({'WITH ' + sketch_sql('event_type, bucket', 's', QUANTILES, 2048)}), x AS ({by(DAY)}) SELECT x.event_type, x.bucket, x.count, x.last, z.sketch_p50, z.sketch_p99 FROM x JOIN z USING (event_type, bucket)")
def rollup_sketches(spark, sf):
    e = events(spark, sf)
    rollups = Rollups(["event_type"]).materialize(e, "1h", ["6h"], sketches=True)
    if rollups.choose("1d", ["last", "sketch_p50"]).width != Width(6, "hours"):
        raise AssertionError("a tier of six hours can give days")
    made = rollups.downsample(e, "1d", ["last", "sketch_p50", "sketch_p99"])
    return made.withColumns({a: F.round(a, 6) for a in ("sketch_p50", "sketch_p99")})


@query(f"WITH {ST}, r AS (SELECT * FROM st WHERE true QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts)) SELECT series_key, ts - ts % {DAY} AS bucket, count(*) AS count, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, sum(value)::DOUBLE AS sum FROM r WHERE value IS NOT NULL GROUP BY ALL")
def downsample_stored(spark, sf):
    rows = reads.time_range(stored(spark, sf)).withColumnRenamed("row_seq", "seq")
    return downsample(rows, "1d", ["min", "max", "sum"], ["series_key"])


@query("SELECT 21600000 AS a, 7855 AS b, 1 AS c, 60000 AS d")
def panel_widths(spark, sf):
    day = 86_400_000
    return spark.createDataFrame([(panel_width(0, 30 * day, None, 120), panel_width(0, day, None, 11_000), panel_width(5, 5), panel_width(0, day, 60_000, 100_000))], "a long, b long, c long, d long")


@query(f"WITH {EV} SELECT seq, ts // 86400000000 AS day, ts // 604800000000 AS week, ts // 2592000000000 AS month, ts // 31536000000000 AS year, ts // 7000 AS ms7, ts // 7000 * 7000 AS ms7_start FROM ev")
def bucket_indexes(spark, sf):
    e, i = events(spark, sf), lambda w: bucket_index(F.col("ts"), w)
    return e.select("seq", i("1d").alias("day"), i("1w").alias("week"), i("1mo").alias("month"), i("1y").alias("year"), i("7ms").alias("ms7"), bucket_start(i("7ms"), "7ms").alias("ms7_start"))


@query(f"WITH {EV} SELECT seq, (ts - {BEGIN}) // 3600000000 AS hours, ((ts - {BEGIN}) // 3600000000) // 720 AS months, (ts - {BEGIN}) * 1000 AS nanos, make_timestamp(ts) AS at FROM ev")
def scalar_units(spark, sf):
    e = events(spark, sf)
    hours = units_between(F.col("ts"), F.lit(BEGIN), "hours")
    return e.select("seq", hours.alias("hours"), convert_distance(hours, "hours", "months").alias("months"), units_between(F.col("ts"), F.lit(BEGIN), "nanoseconds").alias("nanos"), moment("ts").alias("at"))


@query(f"WITH {EV} SELECT seq, ts, strftime(make_timestamp(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM ev")
def rfc3339_times(spark, sf):
    e = events(spark, sf)
    east = F.concat(F.date_format(moment("later"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789+05:30"))  # nine digits, another offset
    e = e.withColumn("later", F.col("ts") + 5 * HOUR + HOUR // 2).withColumn("text", F.when(F.col("seq") % 2 == 0, east).otherwise(rfc3339("ts")))
    return e.withColumn("ts", instant("text")).select("seq", "ts", rfc3339("ts").alias("text"))


# Gap fill.
FILL = f"""WITH {HR}, g AS (SELECT event_type, unnest(generate_series(a, b, {HOUR})) AS ts FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hr GROUP BY ALL)),
n AS (SELECT event_type, ts, count(*) AS count FROM (SELECT event_type, ts - ts % {HOUR} AS ts FROM ev) GROUP BY ALL),
m AS (SELECT g.event_type, g.ts, coalesce(n.count, 0) AS count, hr.value, last_value(CASE WHEN value IS NOT NULL THEN {{'t': g.ts, 'v': value}} END IGNORE NULLS) OVER p AS p, first_value(CASE WHEN value IS NOT NULL THEN {{'t': g.ts, 'v': value}} END IGNORE NULLS) OVER q AS q
  FROM g LEFT JOIN hr USING (event_type, ts) LEFT JOIN n USING (event_type, ts)
  WINDOW p AS (PARTITION BY g.event_type ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY g.event_type ORDER BY g.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def filled(spark, sf, method, **how):
    return fill(downsample(events(spark, sf), "1h", ["avg"], ["event_type"]), "1h", method, ["avg"], ["event_type"], chunk=100, **how)


@query(f"{FILL} SELECT event_type, ts AS bucket, count, value AS avg FROM m")
def fill_null(spark, sf):
    return filled(spark, sf, "null")


@query(f"{FILL} SELECT event_type, ts AS bucket, count, p.v AS avg FROM m")
def fill_prev(spark, sf):
    return filled(spark, sf, "prev")


@query(f"{FILL} SELECT event_type, ts AS bucket, count, coalesce(value, p.v + (q.v - p.v) * ((ts - p.t) // {HOUR}) / ((q.t - p.t) // {HOUR})) AS avg FROM m")
def fill_linear(spark, sf):
    return filled(spark, sf, "linear")


@query(f"{FILL} SELECT event_type, ts AS bucket, count, coalesce(value, p.v + (q.v - p.v) * ((ts - p.t) // {HOUR}) / ((q.t - p.t) // {HOUR})) AS avg FROM m WHERE ts BETWEEN {BEGIN + 3 * DAY} AND {BEGIN + 5 * DAY}")
def fill_linear_bounded(spark, sf):
    return filled(spark, sf, "linear", start=BEGIN + 3 * DAY, end=BEGIN + 5 * DAY)


@query(f"SELECT {BEGIN} + i * {HOUR} AS bucket, 0::BIGINT AS count, NULL::DOUBLE AS avg FROM range(0, 3) t(i)")
def fill_empty(spark, sf):
    none = downsample(events(spark, sf).where("false"), "1h", ["avg"])
    return fill(none, "1h", "null", ["avg"], start=BEGIN, end=BEGIN + 2 * HOUR)


@query(f"{FILL} SELECT event_type, ts AS bucket, count, coalesce(value, -1.5) AS avg FROM m")
def fill_constant(spark, sf):
    return filled(spark, sf, -1.5)


@query(f"{FILL} SELECT event_type, ts AS bucket, count, p.v AS avg FROM m WHERE ts BETWEEN {BEGIN + 3 * DAY} AND {BEGIN + 5 * DAY}")
def fill_prev_bounded(spark, sf):
    return filled(spark, sf, "prev", start=BEGIN + 3 * DAY, end=BEGIN + 5 * DAY)


#: Added before rounding, so that no result lies where two engines may round apart.
OFF = 3.14159e-6


def rounded(c: str):
    return F.round(F.col(c) + OFF, 5)


def lagrange(size: int, cubic: bool = False, bound: float | None = None, step: int = HOUR, knots: str = "hr") -> str:
    value = "CASE WHEN raw IS NOT NULL THEN raw" + (" WHEN ts < lo AND n >= 4 THEN first_v WHEN ts > hi AND n >= 4 THEN last_v" if cubic else "") + " ELSE {} END"
    value = value.format(f"CASE WHEN ts < lo OR ts > hi THEN least(greatest(poly, low - {bound} * (high - low)), high + {bound} * (high - low)) ELSE poly END" if bound is not None else "poly")
    return f"""k AS (SELECT event_type, ts AS x, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM {knots}),
z AS (SELECT event_type, count(*) AS n, min(x) AS lo, max(x) AS hi, min(y) AS low, max(y) AS high, arg_min(y, x) AS first_v, arg_max(y, x) AS last_v FROM k GROUP BY ALL),
a AS (SELECT g.event_type, g.ts, z.*EXCLUDE (event_type), least({size}, n) AS w, coalesce(k.i + 1, 0) AS a, CASE WHEN k.x = g.ts THEN k.y END AS raw FROM g JOIN z USING (event_type) ASOF LEFT JOIN k ON g.event_type = k.event_type AND g.ts >= k.x),
s AS (SELECT *, greatest(0, least(a - w // 2, n - w)) AS s FROM a),
t AS (SELECT s.event_type, s.ts, any_value(j.y) * product(CASE WHEN m.i = j.i THEN 1.0 ELSE (s.ts - m.x)::DOUBLE / (CASE WHEN m.i = j.i THEN 1 ELSE j.x - m.x END)::DOUBLE END) AS term
  FROM s JOIN k j ON j.event_type = s.event_type AND j.i >= s AND j.i < s + w JOIN k m ON m.event_type = s.event_type AND m.i >= s AND m.i < s + w GROUP BY s.event_type, s.ts, j.i),
v AS (SELECT event_type, ts, sum(term) AS poly FROM t GROUP BY ALL)
SELECT event_type, ts, round({value} + {OFF}, 5) AS value, CASE WHEN raw IS NOT NULL THEN 'raw' WHEN ts < lo OR ts > hi THEN 'extrapolated' ELSE 'interpolated' END AS kind FROM s JOIN v USING (event_type, ts)"""


GRID = f"g AS (SELECT event_type, unnest(generate_series({BEGIN - 2 * HOUR}, {BEGIN + 10 * DAY}, {HOUR // 2})) AS ts FROM (SELECT DISTINCT event_type FROM hr))"
SPAN = {"start": BEGIN - 2 * HOUR, "end": BEGIN + 10 * DAY}


def reconstructed(spark, sf, method, **how):
    rows = hourly(spark, sf).withColumn("seq", F.lit(0))
    return interpolate(rows, "30m", method, ["event_type"], **(SPAN | how)).withColumn("value", rounded("value"))


@query(f"WITH {HR}, {GRID}, {lagrange(2)}")
def interpolate_linear(spark, sf):
    return reconstructed(spark, sf, "linear")


@query(f"WITH {NULLED}, hr AS (SELECT coalesce(event_type, '-') AS event_type, ts - ts % {HOUR} AS ts, sum(value)::DOUBLE / count(*) AS value FROM ev GROUP BY ALL), {GRID}, j AS ({'WITH ' + lagrange(2)}) SELECT nullif(event_type, '-') AS event_type, ts, value, kind FROM j")
def interpolate_null_group(spark, sf):
    rows = downsample(nulled(spark, sf), "1h", ["avg"], ["event_type"]).select("event_type", F.col("bucket").alias("ts"), F.col("avg").alias("value"))
    return interpolate(rows, "30m", "linear", ["event_type"], **SPAN).withColumn("value", rounded("value"))


@query(f"WITH {HR}, {GRID}, {lagrange(3)}")
def interpolate_quadratic(spark, sf):
    return reconstructed(spark, sf, "quadratic")


@query(f"WITH {HR}, {GRID}, {lagrange(4, cubic=True)}")
def interpolate_cubic(spark, sf):
    return reconstructed(spark, sf, "cubic")


@query(f"WITH {HR}, {GRID}, {lagrange(6, bound=0.5)}")
def interpolate_polynomial(spark, sf):
    return reconstructed(spark, sf, 5, bound=0.5)


@query(f"WITH {HR}, g AS (SELECT event_type, unnest(generate_series({BEGIN + 20 * DAY}, least({BEGIN + 40 * DAY}, (SELECT max(ts) FROM hr h WHERE h.event_type = e.event_type)), {HOUR // 2})) AS ts FROM (SELECT DISTINCT event_type FROM hr) e), {lagrange(2)}")
def interpolate_within_data(spark, sf):
    return reconstructed(spark, sf, "linear", start=BEGIN + 20 * DAY, end=BEGIN + 40 * DAY, beyond=False)


@query(f"WITH {HR}, g AS (SELECT event_type, {BEGIN + 5 * DAY + 1_234_567} AS ts FROM (SELECT DISTINCT event_type FROM hr)), {lagrange(4, cubic=True)}")
def interpolate_one_point(spark, sf):
    rows = hourly(spark, sf).withColumn("seq", F.lit(0))
    return interpolate_point(rows, BEGIN + 5 * DAY + 1_234_567, "cubic", ["event_type"]).withColumn("value", rounded("value"))


@query(f"""WITH {ST}, n AS (SELECT * FROM st WHERE ts BETWEEN {BEGIN + 2 * DAY - DAY} AND {BEGIN + 3 * DAY + DAY} QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts)),
hr AS (SELECT series_key AS event_type, ts, arg_max(value, row_seq)::DOUBLE AS value FROM n WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series({BEGIN + 2 * DAY}, {BEGIN + 3 * DAY}, 600000000)) AS ts FROM (SELECT DISTINCT event_type FROM hr)), {lagrange(2)}""")
def interpolate_stored_margin(spark, sf):
    a, b = BEGIN + 2 * DAY, BEGIN + 3 * DAY
    rows = reads.time_range(stored(spark, sf), a - DAY, b + DAY).withColumnRenamed("row_seq", "seq").withColumnRenamed("series_key", "event_type")
    return interpolate(rows, "10m", "linear", ["event_type"], a, b, DAY).withColumn("value", rounded("value"))


@query(f"WITH {HR}, g AS (SELECT event_type, unnest(generate_series(a, b, {HOUR})) AS ts FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hr GROUP BY ALL)), {lagrange(3).replace('SELECT event_type, ts, round', 'SELECT event_type, ts AS bucket, round').replace(' AS value, CASE', ' AS avg, CASE')}")
def fill_quadratic(spark, sf):
    made = filled(spark, sf, "quadratic")
    return made.select("event_type", "bucket", rounded("avg").alias("avg"), F.when(F.col("count") > 0, "raw").otherwise("interpolated").alias("kind"))


@query(f"WITH {HR}, g AS (SELECT event_type, unnest(generate_series(a, b, {HOUR})) AS ts FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hr GROUP BY ALL)), {lagrange(4, cubic=True).replace('round(', 'round(').replace('SELECT event_type, ts, round', 'SELECT event_type, ts AS bucket, round').replace(' AS value, CASE', ' AS avg, CASE')}")
def fill_cubic(spark, sf):
    made = filled(spark, sf, "cubic")
    return made.select("event_type", "bucket", rounded("avg").alias("avg"), F.when(F.col("count") > 0, "raw").otherwise("interpolated").alias("kind"))


# Stored reads.
LWW = "SELECT *EXCLUDE (value), value::DOUBLE AS value, 'event_value' AS aspect FROM st"
NEWEST = "QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts)"


@query(f"WITH {ST} {LWW} WHERE ts BETWEEN {BEGIN + DAY} AND {BEGIN + 6 * DAY} {NEWEST}")
def read_time_range(spark, sf):
    return reads.time_range(stored(spark, sf), BEGIN + DAY, BEGIN + 6 * DAY)


@query(f"WITH {ST} {LWW} WHERE true {NEWEST}")
def read_all_history(spark, sf):
    return reads.time_range(stored(spark, sf))


@query(f"WITH {ST} {LWW} WHERE value BETWEEN 20 AND 50.5")
def read_value_band(spark, sf):
    return reads.value_range(stored(spark, sf), 20, 50.5)


INSTANTS = [BEGIN + 5 * HOUR, BEGIN + 7 * DAY, BEGIN + 5 * HOUR, BEGIN + 1, BEGIN + 100 * HOUR]


@query(f"""WITH {ST}, r AS (SELECT unnest(range(0, 5))::INT AS request, unnest({INSTANTS}) AS ts)
SELECT 'event_value' AS aspect, s.series_key, request, r.ts, (SELECT arg_max(value, row_seq) FROM st WHERE st.series_key = s.series_key AND st.ts = r.ts AND value IS NOT NULL AND seal_seq = (SELECT max(seal_seq) FROM st x WHERE x.series_key = s.series_key AND x.ts = r.ts AND x.value IS NOT NULL))::DOUBLE AS value
FROM (SELECT DISTINCT series_key FROM st) s, r""")
def read_points(spark, sf):
    return reads.points(stored(spark, sf), INSTANTS)


@query(f"WITH {ST} {LWW} WHERE series_key = 'click' {NEWEST} ORDER BY ts, row_seq LIMIT 50 OFFSET 30")
def read_page(spark, sf):
    return reads.page(reads.time_range(stored(spark, sf).where("series_key = 'click'")), 50, 30)


@query(f"WITH {ST}, n AS ({LWW} WHERE series_key = 'click' {NEWEST}), c AS (SELECT ts, row_seq FROM n ORDER BY ts, row_seq LIMIT 1 OFFSET 39) SELECT n.* FROM n, c WHERE (n.ts, n.row_seq) > (c.ts, c.row_seq) ORDER BY n.ts, n.row_seq LIMIT 25")
def read_page_by_cursor(spark, sf):
    rows = reads.time_range(stored(spark, sf).where("series_key = 'click'"))
    return reads.page(rows, 25, after=reads.cursor_of(reads.page(rows, 40)))


@query(f"WITH {ST} SELECT 'event_value' AS aspect, series_key, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, min(ts) AS earliest, max(ts) AS latest, arg_min(CASE WHEN value IS NULL THEN -1 ELSE value END, (ts, seal_seq, row_seq)) AS f, arg_max(CASE WHEN value IS NULL THEN -1 ELSE value END, (ts, seal_seq, row_seq)) AS l FROM st GROUP BY ALL".replace("AS f,", "AS first_value,").replace("AS l FROM", "AS last_value FROM").replace("arg_min(CASE WHEN value IS NULL THEN -1 ELSE value END", "first(coalesce(value, -1)::DOUBLE").replace("arg_max(CASE WHEN value IS NULL THEN -1 ELSE value END", "last(coalesce(value, -1)::DOUBLE").replace(", (ts, seal_seq, row_seq))", " ORDER BY ts, seal_seq, row_seq)"))
def read_bounds(spark, sf):
    b = reads.bounds(stored(spark, sf))
    return b.withColumn("first_value", F.coalesce(F.col("first_value").cast("double"), F.lit(-1.0))).withColumn("last_value", F.coalesce(F.col("last_value").cast("double"), F.lit(-1.0)))


@query(f"WITH {ST} {LWW} WHERE ts >= {BEGIN + 20 * DAY}")
def read_live_rows(spark, sf):
    return reads.live(stored(spark, sf), BEGIN + 30 * DAY, 10 * DAY * 1000)


@query(f"WITH {EV}, r AS (SELECT event_type, CASE WHEN seq % 50 = 7 THEN ts - {HOUR} ELSE ts END AS ts, seq FROM ev), l AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY seq) AS p FROM r) SELECT event_type, min(seq) AS row_seq, arg_min(p, seq) AS previous, arg_min(ts, seq) AS current FROM l WHERE p > ts GROUP BY ALL")
def order_violations(spark, sf):
    e = events(spark, sf).withColumn("ts", F.when(F.col("seq") % 50 == 7, F.col("ts") - HOUR).otherwise(F.col("ts"))).withColumnRenamed("seq", "row_seq")
    return reads.order_violations(e, ["event_type"])


DAYSEG = f"d AS (SELECT event_type AS series_key, ts, seq AS row_seq, ts // {2 * DAY} AS seal_seq FROM ev UNION ALL SELECT event_type, ts + {DAY}, seq, 1000 + ts // {7 * DAY} FROM ev WHERE seq % 9 = 0)"


def day_segments(spark, sf):
    e = events(spark, sf).withColumnRenamed("seq", "row_seq").withColumn("series_key", F.col("event_type")).withColumn("aspect", F.lit("event_value"))
    a = e.withColumn("seal_seq", F.floor(F.col("ts") / (2 * DAY)))
    b = e.where("row_seq % 9 = 0").withColumn("seal_seq", 1000 + F.floor(F.col("ts") / (7 * DAY))).withColumn("ts", F.col("ts") + DAY)
    return a.unionByName(b)


@query(f"""WITH {EV}, {DAYSEG}, s AS (SELECT series_key, seal_seq, min(ts) AS lo, max(ts) AS hi, count(*) AS rows FROM d GROUP BY ALL),
o AS (SELECT *, coalesce(lo <= max(hi) OVER (PARTITION BY series_key ORDER BY lo, seal_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS x FROM s)
SELECT 'event_value' AS aspect, series_key, count(*) AS segments, sum(rows)::BIGINT AS rows, 0::BIGINT AS unsorted_segments, count(*) FILTER (x) AS overlapping_segments FROM o GROUP BY ALL""")
def segment_stats(spark, sf):
    return reads.segment_stats(day_segments(spark, sf))


@query(f"""WITH {EV}, {DAYSEG}, s AS (SELECT series_key, seal_seq, min(ts) AS lo, max(ts) AS hi FROM d GROUP BY ALL),
o AS (SELECT *, coalesce((lo > max(hi) OVER (PARTITION BY series_key ORDER BY lo, seal_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS x FROM s)
SELECT 'event_value' AS aspect, series_key, seal_seq, lo, hi, (sum(x) OVER (PARTITION BY series_key ORDER BY lo, seal_seq))::BIGINT AS overlap_group FROM o""")
def overlap_groups(spark, sf):
    return reads.overlap_groups(day_segments(spark, sf))


@query(f"""WITH {ST}, t AS (SELECT series_key, ts, count(*) AS rows FROM st GROUP BY ALL)
SELECT 'event_value' AS aspect, series_key, ts, rows, (coalesce(sum(rows) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100)::BIGINT AS part FROM t""")
def segment_size_cuts(spark, sf):
    return reads.size_cuts(stored(spark, sf), 100)


# Tags and series keys.
def tagged(spark, sf):
    e = events(spark, sf)
    return e.withColumn("tags", F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("type"), "event_type", F.lit("half"), F.lit("even"))).otherwise(F.create_map(F.lit("type"), "event_type")))


@query(f"WITH {EV} SELECT CASE WHEN user_id % 2 = 0 THEN 'half' || chr(31) || 'even' || chr(30) ELSE '' END || 'type' || chr(31) || event_type AS series_key, count(*) AS n FROM ev GROUP BY ALL")
def series_keys(spark, sf):
    return tagged(spark, sf).groupBy(tags.series_key(F.col("tags")).alias("series_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT seq FROM ev WHERE event_type = 'click' AND user_id % 2 = 1")
def series_selected_exactly(spark, sf):
    t = tagged(spark, sf)
    return t.where(tags.select_series(tags.tags_of(tags.series_key(F.col("tags"))), {"type": "click"}, exact=True)).select("seq")


@query(f"WITH {EV} SELECT seq FROM ev WHERE event_type = 'click' AND user_id % 2 = 0")
def series_selected_by_subset(spark, sf):
    return tagged(spark, sf).where(tags.select_series(F.col("tags"), {"type": "click", "half": "even", "none": None})).select("seq")


@query("SELECT 'a' AS name, true AS ok UNION ALL SELECT 'b', false UNION ALL SELECT 'c', false UNION ALL SELECT 'd', true")
def tag_rules(spark, sf):
    rows = spark.createDataFrame([("a", {"host": "x"}), ("b", {"__own": "x"}), ("c", {"host": ""}), ("d", None)], "name string, tags map<string,string>")
    return rows.select("name", tags.valid_tags(F.col("tags")).alias("ok"))


# Decimals.
@query(f"WITH {EV} SELECT event_type, 'scaled_i64' AS encoding FROM ev GROUP BY ALL")
def recommended_encodings(spark, sf):
    return decimals.recommend_encoding(events(spark, sf), group=("event_type",))


@query(f"WITH {EV} SELECT seq, (value * 100)::BIGINT AS mantissa, value::DOUBLE AS back, 0.0::DOUBLE AS error FROM ev")
def encoded_scaled(spark, sf):
    v = F.col("value")
    stored_as = decimals.encode(v, "scaled_i64", 2)
    return events(spark, sf).select("seq", stored_as.alias("mantissa"), decimals.decode(stored_as, "scaled_i64", 2).alias("back"), decimals.encoding_error(v, "scaled_i64", 2).alias("error"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2)::DOUBLE AS price FROM lineitem")
def shortest_decimals(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", decimals.shortest(F.col("l_extendedprice"), 18, 2).alias("price"))


@query("SELECT * FROM (VALUES ('1.50', true, 3, 1.5), ('-2e3', true, 4, -2000), ('nan', false, NULL, NULL), ('1e-3', true, 4, 0.001), ('', false, NULL, NULL)) t(text, ok, digits, value)".replace("digits, value)", "digits, v)").replace("SELECT *", "SELECT text, ok, digits, v::DOUBLE AS value"))
def parsed_decimals(spark, sf):
    t = spark.createDataFrame([("1.50",), ("-2e3",), ("nan",), ("1e-3",), ("",)], "text string")
    c = F.col("text")
    return t.select("text", decimals.is_decimal(c).alias("ok"), F.when(decimals.is_decimal(c), decimals.plain_digits(c)).alias("digits"), decimals.parse_decimal(c).alias("value"))


# Detectors, over hourly means of each event type.
CL = f"{HR}, c AS (SELECT event_type, ts, value, lag(value) OVER w AS p, lag(ts) OVER w AS pt, lead(value) OVER w AS q, lead(ts) OVER w AS qt, max(value) OVER (PARTITION BY event_type) AS high, min(value) OVER (PARTITION BY event_type) AS low FROM hr WINDOW w AS (PARTITION BY event_type ORDER BY ts))"


for _name, _f, _how, _where, _span in (
    ("detect_peaks", detect.peaks, {}, "p < value AND q < value AND value = high", "pt, qt"),
    ("detect_all_peaks", detect.peaks, {"everywhere": True}, "p < value AND q < value", "pt, qt"),
    ("detect_valleys", detect.valleys, {}, "p > value AND q > value AND value = low", "pt, qt"),
    ("detect_all_valleys", detect.valleys, {"everywhere": True}, "p > value AND q > value", "pt, qt"),
    ("detect_crossing_up", detect.crossings, {"threshold": 50.0, "up": True}, "p < 50 AND 50 <= value", "pt, ts"),
    ("detect_crossing_down", detect.crossings, {"threshold": 50.0, "up": False}, "p > 50 AND 50 >= value", "pt, ts"),
):

    def _detector(spark, sf, f=_f, how=_how):
        return f(hourly(spark, sf), group=["event_type"], name="e", **how)

    _detector.__name__ = _name
    _a, _b = _span.split(", ")
    query(f"WITH {CL} SELECT event_type, 'e' AS event, {_a} AS start, {_b} AS \"end\" FROM c WHERE {_where}")(_detector)


@query(f"""WITH {HR}, m AS (SELECT event_type, date_trunc('month', make_timestamp(ts)) AS month, arg_min(value, ts) AS a, arg_max(value, ts) AS b, min(ts) AS s, max(ts) AS e, count(*) AS n FROM hr GROUP BY ALL)
SELECT event_type, 'monthly_increase' AS event, s AS start, e AS "end" FROM m WHERE n >= 2 AND (b - a) / nullif(a, 0) >= 0.05""")
def detect_monthly_increase(spark, sf):
    return detect.monthly_increase(hourly(spark, sf), 5.0, ["event_type"])


@query(f"""WITH RECURSIVE {HR}, o AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM hr),
r AS (SELECT event_type, i, value AS high, ts AS high_ts, NULL::BIGINT AS s, NULL::BIGINT AS e FROM o WHERE i = 1
  UNION ALL SELECT o.event_type, o.i,
    CASE WHEN o.value > r.high OR (r.high <> 0 AND (r.high - o.value) / r.high >= 0.5) THEN o.value ELSE r.high END,
    CASE WHEN o.value > r.high OR (r.high <> 0 AND (r.high - o.value) / r.high >= 0.5) THEN o.ts ELSE r.high_ts END,
    CASE WHEN NOT o.value > r.high AND r.high <> 0 AND (r.high - o.value) / r.high >= 0.5 THEN r.high_ts END,
    CASE WHEN NOT o.value > r.high AND r.high <> 0 AND (r.high - o.value) / r.high >= 0.5 THEN o.ts END
  FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
SELECT event_type, 'drawdown' AS event, s AS start, e AS "end" FROM r WHERE s IS NOT NULL""")
def detect_drawdown(spark, sf):
    return detect.drawdown(hourly(spark, sf), 0.5, ["event_type"])


@query(f"WITH {CL} SELECT event_type, 'up' AS event, pt AS start, ts AS \"end\" FROM c WHERE ts >= {BEGIN + 10 * DAY} AND pt >= {BEGIN + 10 * DAY} AND p < 60 AND 60 <= value UNION ALL SELECT event_type, 'own', ts, ts FROM c WHERE ts >= {BEGIN + 10 * DAY} AND value > 90")
def detect_registered(spark, sf):
    own = lambda df: df.where("value > 90").select("event_type", F.lit("own").alias("event"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    return detect.Registry(["event_type"]).register_builtin("crossings", "up", threshold=60.0).register("own", own).run(hourly(spark, sf), BEGIN + 10 * DAY)


@query(f"WITH {CL} SELECT event_type, ts, value, value - p AS rise, sign((value - p) / (ts - pt))::INT AS direction, pt + (ts - pt) // 2 AS middle FROM c WHERE p IS NOT NULL")
def slopes(spark, sf):
    c = neighbours(hourly(spark, sf), ["event_type"]).where("p is not null")
    return c.select("event_type", "ts", "value", (F.col("value") - F.col("p")).alias("rise"), intervals.slope_sign(F.col("pt"), F.col("p"), F.col("ts"), F.col("value")).alias("direction"), intervals.midpoint(F.col("pt"), F.col("ts")).alias("middle"))


# Shapes.
BATCH = f"""{HR}, b AS (SELECT event_type, ts AS begin, list({{'x': (ts // 1000000)::DOUBLE, 'y': value}}) OVER w AS p FROM hr WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
f AS (SELECT event_type, begin, p FROM b WHERE len(p) = 12)"""
LEVEL = """l AS (SELECT event_type, begin, list_transform(p, lambda q: {'x': q.x - p[1].x, 'y': q.y - p[1].y * (1 - (q.x - p[1].x) / (p[12].x - p[1].x)) - p[12].y * ((q.x - p[1].x) / (p[12].x - p[1].x))}) AS p FROM f)"""


def batches(spark, sf):
    return shapes.sliding(hourly(spark, sf), 12, ["event_type"])


@query(f"WITH {BATCH} SELECT event_type, begin, len(p) AS n, round(list_sum(list_transform(p, lambda q: q.y)), 6) AS total FROM f")
def sliding_batches(spark, sf):
    b = batches(spark, sf)
    return b.select("event_type", "begin", F.size("points").cast("long").alias("n"), F.round(F.aggregate(F.transform("points", lambda p: p["y"]), F.lit(0.0), lambda a, y: a + y), 6).alias("total"))


@query(f"WITH {BATCH}, {LEVEL} SELECT event_type, begin, round(p[1].y, 6) AS a, round(p[5].y, 6) AS b, round(p[12].y, 6) AS c, p[12].x AS width FROM l")
def leveled_batches(spark, sf):
    b = batches(spark, sf).withColumn("points", shapes.to_origin(shapes.level(F.col("points"))))
    y = lambda i: F.round(F.element_at("points", i)["y"], 6) + 0.0
    return b.select("event_type", "begin", y(1).alias("a"), y(5).alias("b"), y(12).alias("c"), F.element_at("points", 12)["x"].alias("width"))


@query(f"""WITH {BATCH}, s AS (SELECT event_type, begin, list_filter(p, lambda q, i: i = 1 OR i = 12 OR sign(q.y - p[i - 1].y) <> sign(p[i + 1].y - q.y)) AS p FROM f)
SELECT event_type, begin, len(p) AS kept FROM s""")
def simplified_batches(spark, sf):
    return batches(spark, sf).select("event_type", "begin", F.size(shapes.simplify(F.col("points"))).cast("long").alias("kept"))


@query(f"""WITH {BATCH}, m AS (SELECT event_type, begin, p, list_max(list_transform(p, lambda q: q.y)) - list_min(list_transform(p, lambda q: q.y)) AS h, p[12].x - p[1].x AS w FROM f)
SELECT event_type, begin, round(p[7].y / h, 6) AS y7, round(p[7].x / w, 6) AS x7 FROM m WHERE h <> 0""")
def relative_batches(spark, sf):
    b = batches(spark, sf).withColumn("points", shapes.relative(F.col("points"))).where("points is not null")
    return b.select("event_type", "begin", F.round(F.element_at("points", 7)["y"], 6).alias("y7"), F.round(F.element_at("points", 7)["x"], 6).alias("x7"))


@query(f"""WITH {BATCH}, {LEVEL}, s AS (SELECT event_type, begin, list_filter(p, lambda q, i: i = 1 OR i = 12 OR sign(q.y - p[i - 1].y) <> sign(p[i + 1].y - q.y)) AS p FROM l),
m AS (SELECT *, list_max(list_transform(p, lambda q: q.y)) - list_min(list_transform(p, lambda q: q.y)) AS h, list_max(list_transform(p, lambda q: q.x)) - list_min(list_transform(p, lambda q: q.x)) AS w FROM s),
r AS (SELECT event_type, begin, list_transform(p, lambda q: {{'x': q.x / w, 'y': q.y / h}}) AS p FROM m WHERE w <> 0 AND h <> 0),
a AS (SELECT event_type, begin, i, least(1.0::DOUBLE, i / 7.0::DOUBLE) AS s, list_filter(p, lambda q: q.x <= least(1.0::DOUBLE, i / 7.0::DOUBLE))[-1] AS l, list_filter(p, lambda q: q.x >= least(1.0::DOUBLE, i / 7.0::DOUBLE))[1] AS r FROM r, range(0, 8) t(i)),
y AS (SELECT event_type, begin, i, round(coalesce(l.y + (r.y - l.y) * (s - l.x) / nullif(r.x - l.x, 0), l.y, r.y) + 3.14159e-6, 5) AS y FROM a)
SELECT event_type, begin, {', '.join(f'max(y) FILTER (i = {i}) AS y{i}' for i in range(8))} FROM y GROUP BY ALL""")
def processed_shapes(spark, sf):
    made = shapes.process(batches(spark, sf)).select("event_type", "begin", shapes.resample(F.col("points"), 8).alias("y"))
    return made.select("event_type", "begin", *[F.round(F.get("y", F.lit(i)) + OFF, 5).alias(f"y{i}") for i in range(8)])


@query(f"""WITH {HR}, c AS (SELECT *, sign(value - lag(value) OVER w) AS b, sign(lead(value) OVER w - value) AS a FROM hr WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, ts, value FROM c WHERE a IS NULL OR b IS NULL OR a <> b""")
def slope_change_rows(spark, sf):
    return shapes.slope_changes(hourly(spark, sf), ["event_type"])


@query(f"WITH {EV}, c AS (SELECT DISTINCT ts - ts % {DAY} AS lo FROM ev) SELECT DISTINCT {BEGIN} + i * {HOUR} AS \"window\" FROM c, range(0, 800) t(i) WHERE {BEGIN} + i * {HOUR} <= lo + {2 * HOUR} AND {BEGIN} + (i + 23) * {HOUR} >= lo AND {BEGIN} + (i + 23) * {HOUR} <= {BEGIN + 29 * DAY}")
def affected_windows(spark, sf):
    e = events(spark, sf).select((F.col("ts") - F.pmod("ts", F.lit(DAY))).alias("lo")).distinct().withColumn("hi", F.col("lo") + 2 * HOUR)
    return shapes.affected_windows(e, BEGIN, HOUR, 24, BEGIN + 29 * DAY)


PAIRS = f"{BATCH}, v AS (SELECT event_type, begin, list_transform(p, lambda q: q.y - 50) AS y FROM f), pr AS (SELECT a.event_type, a.begin, a.y AS a, b.y AS b FROM v a JOIN v b ON a.event_type = b.event_type AND b.begin = a.begin + {3 * HOUR})"


def pairs(spark, sf):
    v = batches(spark, sf).select("event_type", "begin", F.transform("points", lambda p: p["y"] - 50).alias("y"))
    return v.withColumnRenamed("y", "a").join(v.select("event_type", (F.col("begin") - 3 * HOUR).alias("begin"), F.col("y").alias("b")), ["event_type", "begin"])


def _constraint_sql(kind: str, limit: float) -> str:
    a, b = ("list_transform(a, lambda x: abs(x))", "list_transform(b, lambda x: abs(x))") if "_absolute" in kind else ("a", "b")
    apart = f"list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))"
    share = "CASE WHEN {1} <> 0 THEN {0} / {1} * 100 WHEN {0} = 0 THEN 0 ELSE 10000 END"
    each = f"list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[2] <> 0 THEN abs(z[1] - z[2]) / abs(z[2]) * 100 WHEN z[1] = z[2] THEN 0 ELSE 10000 END)"
    m, p = kind.split("_")[0], kind.endswith("percentile")
    found = {
        ("max", False): f"abs(list_max({a}) - list_max({b}))", ("average", False): f"list_sum({apart}) / len(a)", ("sum", False): f"abs(list_sum({a}) - list_sum({b}))",
        ("max", True): f"list_max({each})", ("average", True): f"list_sum({each}) / len(a)", ("sum", True): share.format(f"abs(list_sum({a}) - list_sum({b}))", f"list_sum({b})"),
    }[(m, p)]
    return f"({found}) <= {limit}"


LIMITS = {k: (60.0 if k.endswith("percentile") else {"max": 9.0, "average": 15.0, "sum": 80.0}[k.split("_")[0]]) for k in similarity.CONSTRAINTS}


@query(f"WITH {PAIRS} SELECT event_type, begin, {', '.join(f'{_constraint_sql(k, v)} AS {k}' for k, v in LIMITS.items())} FROM pr")
def similarity_constraints(spark, sf):
    return pairs(spark, sf).select("event_type", "begin", *[similarity.constraint(k, F.col("a"), F.col("b"), v).alias(k) for k, v in LIMITS.items()])


def _shapes(spark, sf):
    b = shapes.process(batches(spark, sf))
    return b.withColumn("shape", shapes.resample(F.col("points"), 8))


@query()
def dictionary_import(spark, sf):
    return similarity.import_patterns(_shapes(spark, sf), {"average_static": 0.2, "max_static": 0.5}, ["event_type"]).select("event_type", "pattern", F.size("occurrences").alias("n"))


@query()
def dictionary_learned(spark, sf):
    return similarity.import_patterns(_shapes(spark, sf), None, ["event_type"]).select("event_type", "pattern", F.size("occurrences").alias("n"))


# Correlations and signals: crossings are the events, quiet hours the occurrences.
MEN = f"{HR}, n AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM hr WINDOW w AS (PARTITION BY event_type ORDER BY ts)), men AS (SELECT event_type, 'up' AS event, pt AS start, ts AS \"end\" FROM n WHERE p < 50 AND 50 <= value), occ AS (SELECT event_type, user_id % 3 AS pattern, ts - ts % {HOUR} AS begin, ts - ts % {HOUR} + {3 * HOUR} AS \"end\" FROM ev GROUP BY ALL), cor AS (SELECT event_type, event, pattern, {HOUR} AS step, (sum(g) FILTER (g > 0) // nullif(count(*) FILTER (g > 0), 0))::BIGINT AS average_distance FROM (SELECT event_type, event, (lead(start) OVER (PARTITION BY event_type ORDER BY start) - start) // {HOUR} AS g FROM men) JOIN (SELECT DISTINCT event_type, pattern FROM occ) USING (event_type) GROUP BY ALL)"
SIG = f"""{MEN}, h AS (SELECT m.event_type, m.event, o.pattern, m.start, m."end", max(o."end") AS d FROM men m JOIN occ o ON o.event_type = m.event_type AND o."end" < m.start GROUP BY ALL),
past AS (SELECT event_type, event, pattern, {HOUR} AS step, start AS manifestation_start, d AS date, k AS signal_type, (t - d) // {HOUR} AS distance, false AS forward FROM (SELECT *, unnest(['start', 'mid', 'end']) AS k, unnest([start, start + ("end" - start) // 2, "end"]) AS t FROM h)),
ahead AS (SELECT o.event_type, l.event, o.pattern, {HOUR} AS step, NULL::BIGINT AS manifestation_start, o."end" AS date, 'start' AS signal_type, m.distance, true AS forward FROM occ o JOIN (SELECT event_type, event, max("end") AS last FROM men GROUP BY ALL) l ON l.event_type = o.event_type AND o."end" > l.last JOIN (SELECT event_type, event, pattern, min(distance) AS distance FROM past WHERE signal_type = 'start' AND distance > 0 GROUP BY ALL) m ON m.event_type = o.event_type AND m.event = l.event AND m.pattern = o.pattern),
sig AS (SELECT * FROM past UNION ALL SELECT * FROM ahead)"""
NOW = BEGIN + 25 * DAY


def _relations(spark, sf):
    men = detect.crossings(hourly(spark, sf), 50.0, True, ["event_type"], "up")
    hour = F.col("ts") - F.pmod("ts", F.lit(HOUR))
    occ = events(spark, sf).select("event_type", (F.col("user_id") % 3).alias("pattern"), hour.alias("begin"), (hour + 3 * HOUR).alias("end")).distinct()
    cor = signals.correlate(men, occ.select("event_type", "pattern", F.lit(HOUR).alias("step")).distinct(), ["event_type"])
    return men, occ, cor


@query(f"WITH {MEN} SELECT * FROM cor")
def correlations(spark, sf):
    return _relations(spark, sf)[2]


@query(f"WITH {SIG} SELECT * FROM sig")
def signals_found(spark, sf):
    men, occ, cor = _relations(spark, sf)
    return signals.signals(cor, men, occ, ["event_type"])


@query(f"WITH {SIG} SELECT s.* FROM sig s JOIN cor c USING (event_type, event, pattern) WHERE s.date + s.distance * {HOUR} > {NOW} AND (s.manifestation_start IS NULL OR s.manifestation_start + c.average_distance * {HOUR} IS NULL OR s.manifestation_start + c.average_distance * {HOUR} > {NOW})")
def signals_unexpired(spark, sf):
    men, occ, cor = _relations(spark, sf)
    return signals.expire(signals.signals(cor, men, occ, ["event_type"]), cor, NOW, ["event_type"])


@query(f"""WITH {SIG}, x AS (SELECT *, start + ("end" - start) // 2 AS mid FROM men), y AS (SELECT *, lag(mid) OVER (PARTITION BY event_type ORDER BY start) AS mid_before FROM x),
l AS (SELECT event_type, event, max(start) AS ls, arg_max(mid, start) AS lm, arg_max("end", start) AS le FROM y GROUP BY ALL),
z AS (SELECT s.event_type, s.event, s.signal_type, coalesce(c.average_distance, s.distance) AS avg, s.date, CASE WHEN s.forward THEN l.lm ELSE y.mid_before END AS base, CASE s.signal_type WHEN 'start' THEN l.ls WHEN 'mid' THEN l.lm ELSE l.le END AS own
  FROM sig s JOIN cor c USING (event_type, event, pattern) JOIN l USING (event_type, event) LEFT JOIN y ON y.event_type = s.event_type AND y.start = s.manifestation_start WHERE s.date <= {NOW}),
p AS (SELECT *, CASE WHEN ({NOW} - date) // {HOUR} <= 0 THEN 0 ELSE (({NOW} - date) // {HOUR})::DOUBLE / nullif(avg, 0) END AS p, CASE WHEN ({NOW} - base) // {HOUR} <= 0 THEN 0 ELSE (({NOW} - base) // {HOUR})::DOUBLE / nullif(avg, 0) END AS q, CASE WHEN ({NOW} - own) // {HOUR} <= 0 THEN 0 ELSE (({NOW} - own) // {HOUR})::DOUBLE / nullif(avg, 0) END AS r FROM z)
SELECT event_type, event, signal_type, count(*) AS signals, round(sum(p) FILTER (p > 0), 6) AS probability_sum, round(avg(q) FILTER (q > 0), 6) AS probability_average, round(avg(r) FILTER (r > 0), 6) AS event_probability FROM p GROUP BY ALL""")
def signal_probabilities(spark, sf):
    men, occ, cor = _relations(spark, sf)
    out = signals.probabilities(signals.signals(cor, men, occ, ["event_type"]), cor, men, NOW, ["event_type"])
    return out.select("event_type", "event", "signal_type", "signals", *[F.round(c, 6).alias(c) for c in ("probability_sum", "probability_average", "event_probability")])


@query()
def analysis_pipeline(spark, sf):
    run = Analysis(events(spark, sf), ["event_type"], "6h", "linear", 12, 8, {"average_static": 0.25, "max_static": 0.5})
    run.detectors.register_builtin("peaks", everywhere=True).register_builtin("crossings", threshold=50.0)
    return run.run().probabilities(BEGIN + 29 * DAY)


# Compression.
@query(f"""WITH {HR}, g AS (SELECT event_type, unnest(generate_series(a, b, {DAY})) AS ts FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hr GROUP BY ALL)), i AS ({'WITH ' + lagrange(2)}),
c AS (SELECT *, sign(value - lag(value) OVER w) AS b, sign(lead(value) OVER w - value) AS a FROM i WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT event_type, ts, value FROM c WHERE a IS NULL OR b IS NULL OR a <> b""")
def compressed(spark, sf):
    rows = hourly(spark, sf).withColumn("seq", F.lit(0))
    return cp.compress(rows, 0.6, "weeks", "hours", "linear", ["event_type"]).withColumn("value", rounded("value"))


@query(f"WITH {HR} SELECT event_type, arg_min(value, ts) AS value, min(ts) AS ts FROM hr GROUP BY event_type UNION ALL SELECT event_type, arg_max(value, ts), max(ts) FROM hr GROUP BY event_type")
def compressed_to_ends(spark, sf):
    return cp.compress(hourly(spark, sf).withColumn("seq", F.lit(0)), 0.99, "weeks", "hours", "linear", ["event_type"])


@query(f"WITH {EV}, a AS (SELECT seq, {BEGIN + 30 * DAY} - ts AS age FROM ev), k AS (SELECT seq, age, least(10, floor((age - {7 * DAY}) / {2 * DAY})) AS k FROM a) SELECT seq, CASE WHEN age <= {7 * DAY} OR k < 1 THEN 0 ELSE least(0.95, k / 10.0::DOUBLE) END::DOUBLE AS linear, round(CASE WHEN age <= {7 * DAY} OR k < 1 THEN 0 ELSE least(0.95, 1 - pow(0.5, k)) END, 9)::DOUBLE AS exponential FROM k")
def tier_aggressiveness(spark, sf):
    age = F.lit(BEGIN + 30 * DAY) - F.col("ts")
    a = lambda s: cp.tier_aggressiveness(age, 7 * DAY, 2 * DAY, 10, s)
    return events(spark, sf).select("seq", a("linear").alias("linear"), F.round(a("exponential"), 9).alias("exponential"))


@query(f"""WITH {HR}, a AS (SELECT *, {BEGIN + 30 * DAY} - ts AS age FROM hr),
k AS (SELECT event_type AS own, ts, value, CASE WHEN age <= {10 * DAY} THEN 0 ELSE least(4, (age - {10 * DAY}) // {5 * DAY}) END AS k FROM a),
lv AS (SELECT own || '|' || k AS event_type, ts, value FROM k WHERE k > 0),
g AS (SELECT event_type, unnest(generate_series(a, b, {HOUR})) AS ts FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM lv GROUP BY ALL)), i AS ({'WITH ' + lagrange(2, knots='lv')}),
c AS (SELECT *, sign(value - lag(value) OVER w) AS b, sign(lead(value) OVER w - value) AS a FROM i WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT split_part(event_type, '|', 1) AS event_type, ts, value FROM c WHERE a IS NULL OR b IS NULL OR a <> b
UNION ALL SELECT own, ts, round(value + {OFF}, 5) FROM k WHERE k = 0""")
def compressed_by_age(spark, sf):
    rows = hourly(spark, sf).withColumn("seq", F.lit(0))
    return cp.compress_by_age(rows, BEGIN + 30 * DAY, 10 * DAY, 5 * DAY, 4, "days", "hours", group=["event_type"]).withColumn("value", rounded("value"))


@query()
def compressed_by_size(spark, sf):
    rows = hourly(spark, sf).withColumn("seq", F.lit(0))
    return cp.compress_by_size(rows, 1500, "days", "hours", group=["event_type"]).withColumn("value", rounded("value"))


# Joins, which the engine adds.
@query(f"WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), p AS (SELECT * FROM ev WHERE event_type = 'purchase') SELECT c.seq, p.ts AS right_ts, p.value::DOUBLE AS right_value FROM c ASOF LEFT JOIN p ON c.ts >= p.ts")
def asof_join(spark, sf):
    e = events(spark, sf)
    right = knots_of(e.where("event_type = 'purchase'"))
    return joins.asof_join(e.where("event_type = 'click'"), right, chunk=DAY).select("seq", "right_ts", "right_value")


@query(f"WITH {CL}, s AS (SELECT event_type, pt AS start, qt AS \"end\" FROM c WHERE p < value AND q < value) SELECT ev.seq, s.start, s.\"end\" FROM ev JOIN s ON ev.event_type = s.event_type AND ev.ts BETWEEN s.start AND s.\"end\"")
def interval_join(spark, sf):
    spans = detect.peaks(hourly(spark, sf), ["event_type"], everywhere=True).select("event_type", "start", "end")
    return joins.interval_join(events(spark, sf), spans, 6 * HOUR, ["event_type"]).select("seq", "start", "end")


# Formats, the store and streams: what is written comes back.
SAME = f"WITH {EV} SELECT ts, value::DOUBLE AS value FROM ev"


def _points(spark, sf):
    return events(spark, sf).select("ts", "value")


@query(SAME)
def csv_round_trip(spark, sf):
    at = fresh(spark, "csv")
    formats.write_csv(_points(spark, sf), at)
    return formats.read_csv(spark, at).drop("seq")


@query("SELECT epoch_us(ts) AS ts, CASE WHEN event_id % 11 <> 0 THEN value::DECIMAL(18,2)::DOUBLE END AS value FROM events")
def csv_columns(spark, sf):
    """Two columns of a file with others, semicolons, time texts, and values that are no numbers."""
    at = fresh(spark, "columns")
    value = F.when(F.col("seq") % 11 != 0, F.col("value").cast("string")).otherwise(F.lit("?"))
    events(spark, sf).select("event_type", F.date_format(moment("ts"), "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("Time of day"), value.alias("P (kW)")).write.option("header", True).option("sep", ";").csv(at)
    return formats.read_columns(spark, at, "Time of day", "P (kW)", ";", format="yyyy/MM/dd HH:mm:ss.SSSSSS").drop("seq")


@query(SAME)
def parquet_round_trip(spark, sf):
    at = fresh(spark, "parquet")
    formats.write_parquet(_points(spark, sf), at)
    return formats.read_parquet(spark, at).drop("seq")


@query(SAME)
def json_ingest_bodies(spark, sf):
    at = fresh(spark, "json")
    body = _points(spark, sf).groupBy(F.floor(F.col("ts") / DAY).alias("d")).agg(F.collect_list(F.struct(F.col("ts").alias("timestamp"), F.col("value").cast("string").alias("value"))).alias("points"))
    body.select("points", F.create_map(F.lit("k"), F.lit("v")).alias("tags"), F.col("d").cast("string").alias("batch_id")).write.json(at)
    return formats.read_json(spark, at).select("ts", "value")


@query(f"WITH {EV} SELECT 'm' AS aspect, 'type' || chr(31) || event_type AS series_key, ts, value::DOUBLE AS value FROM ev")
def json_ingested(spark, sf):
    """Bodies of an event type and a 32nd of the time, which hold the instants of theirs alone, with RFC 3339 times, twice; a batch_id is a key."""
    at, store = fresh(spark, "bodies"), Store(spark, fresh(spark, "store"))
    store.declare(Aspect("m", "scaled_i64", 2))
    point = F.struct(rfc3339("ts").alias("timestamp"), F.col("value").cast("string").alias("value"), "seq")
    e = events(spark, sf)
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor((F.col("ts") - F.lit(first)) / F.lit(((last or 0) - (first or 0)) // 32 + 1))
    body = e.groupBy("event_type", part.alias("part")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    body.select("points", F.create_map(F.lit("type"), "event_type").alias("tags"), F.concat("event_type", F.lit("/"), F.col("part").cast("string")).alias("batch_id"), F.lit(1000).alias("rows_per_page"), F.lit(True).alias("require_sorted")).write.json(at)
    for replayed in (False, True):
        if any(r.replayed != replayed for r in formats.ingest_json(store, "m", at, "rfc3339")):
            raise AssertionError("bodies are ingested once")
    return store.read("m").select("aspect", "series_key", "ts", "value")


@query(SAME)
def arrow_round_trip(spark, sf):
    at = fresh(spark, "arrow")
    formats.write_arrow(_points(spark, sf), at)
    return formats.read_arrow(spark, at)


@query(f"WITH {EV} SELECT 'metric' AS measurement, 'type' || chr(31) || event_type AS series_key, ts, value::DOUBLE AS value FROM ev")
def line_protocol(spark, sf):
    e = events(spark, sf).repartition(spark.sparkContext.defaultParallelism)  # as a text of many splits would be
    line = F.concat(F.lit("metric,type="), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(',note="a, b=c" '), F.col("ts").cast("string"), F.lit("000"))
    records = ilp.strict(ilp.parse_lines(e.select(F.col("seq").alias("line"), line.alias("value"))))
    return ilp.points(records, "value").select("measurement", "series_key", "ts", F.col("value").cast("double").alias("value"))


@query(f"""WITH {EV} SELECT seq AS line, CASE seq % 6 WHEN 5 THEN NULL ELSE 'my metric' END AS measurement, CASE WHEN seq % 6 <> 5 THEN 'k=' || event_type END AS tag,
  CASE seq % 6 WHEN 0 THEN 'float' WHEN 1 THEN 'integer' WHEN 2 THEN 'unsigned' WHEN 3 THEN 'boolean' WHEN 4 THEN 'string' END AS kind,
  CASE seq % 6 WHEN 1 THEN (-seq)::VARCHAR WHEN 2 THEN seq::VARCHAR WHEN 3 THEN 'true' WHEN 4 THEN 'a "b", c=' || seq || ' \\' END AS text,
  CASE WHEN seq % 6 = 0 THEN value::DOUBLE END AS number, CASE WHEN seq % 6 <> 5 AND seq % 4 <> 0 THEN ts END AS ts, seq % 6 = 5 AS bad FROM ev WHERE seq % 7 <> 3""")
def line_protocol_typed(spark, sf):
    """Every kind of field, escapes, comments (each seventh line), missing timestamps, and numbers that aren't any."""
    k = F.col("seq") % 6
    value = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.concat(F.lit("-"), "seq", F.lit("i"))).when(k == 2, F.concat("seq", F.lit("u"))).when(k == 3, F.lit("T"))
    value = value.when(k == 4, F.concat(F.lit('"a \\"b\\", c='), "seq", F.lit(' \\\\"'))).otherwise(F.lit("1_0"))
    line = F.concat(F.lit("my\\ metric,tag\\==k\\="), "event_type", F.lit(" f\\,x="), value, F.when(F.col("seq") % 4 != 0, F.concat(F.lit(" "), F.col("ts").cast("string"))).otherwise(F.lit("")))
    line = F.when(F.col("seq") % 7 == 3, F.lit("# nothing")).otherwise(line)
    r = ilp.parse_lines(events(spark, sf).select(F.col("seq").alias("line"), line.alias("value")))
    f = F.element_at("fields", "f,x")
    return r.select("line", "measurement", F.element_at("tags", "tag=").alias("tag"), f["kind"].alias("kind"), F.when(f["kind"] != "float", f["text"]).alias("text"), F.when(f["kind"] == "float", f["text"].cast("double")).alias("number"), "ts", F.col("error").isNotNull().alias("bad"))


@query(f"WITH {EV} SELECT 'm' AS aspect, 'type' || chr(31) || 'click' AS series_key, ts, value::DOUBLE AS value, 0::BIGINT AS seal_seq, seq AS row_seq FROM ev WHERE event_type = 'click'")
def line_protocol_stored(spark, sf):
    store = Store(spark, fresh(spark, "store"))
    store.declare(Aspect("m", "scaled_i64", 2))
    e = events(spark, sf)
    line = F.concat(F.when(F.col("event_type") == "click", F.lit("metric")).otherwise(F.lit("other")), F.lit(",type="), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(" "), F.col("ts").cast("string"), F.lit("000"))
    ilp.ingest_lines(store, "m", ilp.parse_lines(e.select(F.col("seq").alias("line"), line.alias("value"))), "metric", "value", key="k")
    return store.read("m")


def _store(spark, sf):
    store = Store(spark, fresh(spark, "store"))
    store.declare(Aspect("event_value", "scaled_i64", 2))
    rows = stored(spark, sf)
    for k in range(3):
        part = rows.where(F.col("seal_seq") == k).select("ts", "value", F.create_map(F.lit("type"), "series_key").alias("tags"), F.col("row_seq").alias("seq"))
        store.ingest("event_value", part, key=f"seal-{k}")
        store.ingest("event_value", part, key=f"seal-{k}")  # answered from the ledger
    return store


STORED = f"WITH {ST} SELECT 'event_value' AS aspect, 'type' || chr(31) || series_key AS series_key, ts, value::DOUBLE AS value, seal_seq, row_seq FROM st"


@query(f"{STORED} WHERE series_key = 'click' AND ts BETWEEN {BEGIN + DAY} AND {BEGIN + 6 * DAY} {NEWEST}")
def store_read(spark, sf):
    return _store(spark, sf).read("event_value", BEGIN + DAY, BEGIN + 6 * DAY, {"type": "click"})


@query(f"{STORED} WHERE true {NEWEST}")
def store_squashed(spark, sf):
    store = _store(spark, sf)
    store.squash("event_value")
    return store.read("event_value")


@query(f"{STORED} WHERE ts >= {BEGIN + 20 * DAY} {NEWEST}")
def store_purged(spark, sf):
    store = _store(spark, sf)
    store.purge_expired("event_value", BEGIN + 30 * DAY, 10 * DAY * 1000)
    return store.read("event_value")


@query(f"{STORED} WHERE true {NEWEST}")
def store_replayed(spark, sf):
    """Every ingest fails once between its files and its commit, then is done again, then again."""
    store, rows = Store(spark, fresh(spark, "store")), stored(spark, sf)
    store.declare(Aspect("event_value", "scaled_i64", 2))
    commit = store._commit
    for k in range(3):
        part = rows.where(F.col("seal_seq") == k).select("ts", "value", F.create_map(F.lit("type"), "series_key").alias("tags"), F.col("row_seq").alias("seq"))
        store._commit = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
        try:
            store.ingest("event_value", part, key=f"seal-{k}")
        except RuntimeError:
            pass
        store._commit = commit
        for replayed in (False, True):
            if store.ingest("event_value", part, key=f"seal-{k}").replayed != replayed:
                raise AssertionError("a replay is answered from the log")
    return store.read("event_value")


@query(f"{STORED} WHERE NOT ts BETWEEN {BEGIN + 2 * DAY} AND {BEGIN + 4 * DAY} {NEWEST} UNION ALL SELECT 'event_value', 'type' || chr(31) || event_type, epoch_us(ts) - epoch_us(ts) % {HOUR}, -1.0::DOUBLE, 3, event_id FROM events WHERE epoch_us(ts) - epoch_us(ts) % {HOUR} BETWEEN {BEGIN + 2 * DAY} AND {BEGIN + 4 * DAY}")
def store_replaced(spark, sf):
    store, (a, b) = _store(spark, sf), (BEGIN + 2 * DAY, BEGIN + 4 * DAY)
    new = stored(spark, sf).where(F.col("ts").between(a, b)).select("ts", F.lit(-1).cast("decimal(18,2)").alias("value"), F.create_map(F.lit("type"), "series_key").alias("tags"), F.col("row_seq").alias("seq"))
    store.replace("event_value", new, a, b)
    return store.read("event_value")


@query(f"{STORED} WHERE true QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts) OR seal_seq = max(CASE WHEN value IS NOT NULL THEN seal_seq END) OVER (PARTITION BY series_key, ts)")
def store_overlaps_merged(spark, sf):
    store = _store(spark, sf)
    store.merge_overlaps("event_value")
    return store.rows("event_value").drop("part_day")


@query(f"{STORED} WHERE true {NEWEST}")
def store_reconciled(spark, sf):
    store = _store(spark, sf)
    store.reconcile_all(-1)
    return store.read("event_value")


@query(f"{STORED} WHERE true {NEWEST}")
def store_compacted(spark, sf):
    store = _store(spark, sf)
    store.squash("event_value", 500)
    return store.read("event_value")


@query(f"{STORED} WHERE NOT ts BETWEEN {BEGIN + 2 * DAY} AND {BEGIN + 4 * DAY} {NEWEST}")
def store_cleared(spark, sf):
    store = _store(spark, sf)
    store.clear("event_value", BEGIN + 2 * DAY, BEGIN + 4 * DAY)
    return store.read("event_value")


@query(f"WITH {ST} SELECT 'event_value' AS aspect, 'scaled_i64' AS encoding, 'us' AS unit, 3::BIGINT AS commits, count(*) AS rows, min(ts) AS earliest, max(ts) AS latest FROM st")
def store_catalog(spark, sf):
    return _store(spark, sf).catalog()


@query(f"""WITH {ST}, n AS (SELECT * FROM st WHERE ts BETWEEN {BEGIN + 2 * DAY - DAY} AND {BEGIN + 3 * DAY + DAY} QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts)),
hr AS (SELECT 'type' || chr(31) || series_key AS event_type, ts, arg_max(value, row_seq)::DOUBLE AS value FROM n WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series({BEGIN + 2 * DAY}, {BEGIN + 3 * DAY}, 600000000)) AS ts FROM (SELECT DISTINCT event_type FROM hr)), {lagrange(2)}""")
def store_interpolated(spark, sf):
    """Knots within the range's own length of it, as no margin is said; the grid comes in parts."""
    parts = list(_store(spark, sf).interpolated_parts("event_value", "10m", BEGIN + 2 * DAY, BEGIN + 3 * DAY, points=50, method="linear"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made.withColumnRenamed("series_key", "event_type").withColumn("value", rounded("value"))


@query(f"WITH {ST}, c AS (SELECT seal_seq, min(ts) AS lo, max(ts) AS hi FROM st WHERE seal_seq = 2 GROUP BY ALL) SELECT DISTINCT {BEGIN} + i * {HOUR} AS \"window\" FROM c, range(0, 800) t(i) WHERE {BEGIN} + i * {HOUR} <= hi AND {BEGIN} + (i + 23) * {HOUR} >= lo AND {BEGIN} + (i + 23) * {HOUR} <= {BEGIN + 29 * DAY}")
def store_windows_to_rebuild(spark, sf):
    """Windows that changes since the acknowledged seal touch."""
    store = _store(spark, sf)
    store.ack_changes("event_value", 1)
    return streams.changed_windows(store.pending_changes("event_value"), BEGIN, HOUR, 24, BEGIN + 29 * DAY)


@query(f"WITH {ST}, n AS (SELECT * FROM st WHERE seal_seq < 2 QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts)), d AS (SELECT 'type' || chr(31) || series_key AS series_key, ts - ts % {DAY} AS ts FROM n WHERE value IS NOT NULL GROUP BY ALL), z AS (SELECT series_key, min(ts) AS a, max(ts) AS b FROM d GROUP BY ALL) SELECT series_key, unnest(generate_series(a, b - {3 * DAY}, {DAY})) AS begin, 4::BIGINT AS n FROM z")
def store_batches(spark, sf):
    """All batches of the first two seals; after they are done, those of the first seal alone would be none."""
    store, rows = Store(spark, fresh(spark, "store")), stored(spark, sf)
    store.declare(Aspect("event_value", "scaled_i64", 2))
    for k in range(2):
        store.ingest("event_value", rows.where(F.col("seal_seq") == k).select("ts", "value", F.create_map(F.lit("type"), "series_key").alias("tags"), F.col("row_seq").alias("seq")))
    made, head = streams.Batches(store, "event_value", "1d", 4).unprocessed()
    return made.select("series_key", "begin", F.size("points").cast("long").alias("n"))


@query(f"{STORED} WHERE value BETWEEN 20 AND 50.5")
def store_value_band(spark, sf):
    return _store(spark, sf).read_values("event_value", 20, 50.5)


@query(f"{STORED} WHERE ts >= {BEGIN + 20 * DAY} {NEWEST}")
def store_read_live(spark, sf):
    """The aspect's own time to live, ten days, hides older rows from every read."""
    store, rows = Store(spark, fresh(spark, "store"), clock=lambda: (BEGIN + 30 * DAY) * 1000), stored(spark, sf)
    store.declare(Aspect("event_value", "scaled_i64", 2, ttl_nanos=10 * DAY * 1000))
    for k in range(3):
        store.ingest("event_value", rows.where(F.col("seal_seq") == k).select("ts", "value", F.create_map(F.lit("type"), "series_key").alias("tags"), F.col("row_seq").alias("seq")))
    return store.read("event_value")


@query(f"WITH {ST}, r AS (SELECT * FROM st WHERE true QUALIFY seal_seq = max(seal_seq) OVER (PARTITION BY series_key, ts)) SELECT 'type' || chr(31) || series_key AS series_key, ts - ts % {DAY} AS bucket, count(*) AS count, max(value)::DOUBLE AS max, sum(value)::DOUBLE AS sum FROM r WHERE value IS NOT NULL GROUP BY ALL")
def store_rollup_refreshed(spark, sf):
    """A tier that the last seal outran is rebuilt where that seal touches it, and serves."""
    store, rows = Store(spark, fresh(spark, "store")), stored(spark, sf)
    store.declare(Aspect("event_value", "scaled_i64", 2))
    tiers = StoredRollups(store, "event_value")
    for k in range(3):
        store.ingest("event_value", rows.where(F.col("seal_seq") == k).select("ts", "value", F.create_map(F.lit("type"), "series_key").alias("tags"), F.col("row_seq").alias("seq")))
        if k == 0:
            tiers.materialize("6h")
    if tiers.choose("1d", ["max", "sum"]) is not None or tiers.refresh() != ["6h"] or tiers.choose("1d", ["max", "sum"]) is None:
        raise AssertionError("a stale tier is never served, a refreshed one is")
    return tiers.downsample("1d", ["max", "sum"])


@query(f"WITH {ST} SELECT seal_seq, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS rows FROM st WHERE seal_seq > 0 GROUP BY ALL")
def store_changes(spark, sf):
    return _store(spark, sf).changes_since("event_value", 0)


@query(SAME)
def stream_ingest(spark, sf):
    """An event is a series by its id, so none is a newer version of another that falls on the same instant."""
    at, store = fresh(spark, "stream"), Store(spark, fresh(spark, "store"))
    store.declare(Aspect("event_value"))
    e = events(spark, sf).select("ts", "value", F.create_map(F.lit("event"), F.col("seq").cast("string")).alias("tags"), "seq")
    e.repartition(4).write.parquet(f"{at}/in")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    streams.ingest_stream(source, store, "event_value", f"{at}/checkpoint").awaitTermination()
    return store.read("event_value").select("ts", "value")


@query(by(DAY))
def stream_buckets(spark, sf):
    at, e = fresh(spark, "stream"), events(spark, sf)
    e.repartition(4).write.parquet(f"{at}/in")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    made = streams.bucket_stream(source, "1d", ALL_SIX, ["event_type"])
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    made.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(f"WITH {HR}, j AS (SELECT a.ts, a.value AS x, b.value AS y FROM hr a JOIN hr b ON a.ts = b.ts AND a.event_type = 'click' AND b.event_type = 'view') SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(avg((x + y) / 2), 6) AS cross_average FROM j")
def series_correlation(spark, sf):
    h = hourly(spark, sf)
    x, y = (h.where(F.col("event_type") == t).select("ts", F.col("value").alias(n)) for t, n in (("click", "x"), ("view", "y")))
    return x.join(y, "ts").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.avg((F.col("x") + F.col("y")) / 2), 6).alias("cross_average"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly minimum, maximum and mean by event type."""
    made = downsample(events(spark, sf_dir), Width(1, "hours"), ("min", "max", "avg"), ["event_type"])
    return plain(made.withColumn("bucket_start", moment("bucket")).drop("bucket"))
