"""Queries of bars, indicators, signals, joins and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import bars as B
from .operators import indicators as I  # noqa: E741
from .operators import matching as M
from .operators import signals as G
from .plans import workflows as P
from .queries import query
from .sources import tables as T
from .streaming import feeds as X

TICKS = """ticks AS (SELECT {key} AS symbol, ts, value AS price, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS size, event_id AS id FROM events)"""


def bars_sql(resolution: str = "60", bucket: str | None = None, key: str = "event_type", name: str = "bars") -> str:
    """CTEs ticks and bars."""
    bucket = bucket or f"time_bucket(INTERVAL '{resolution} minutes', ts)"
    return f"""{TICKS.format(key=key)},
{name} AS (SELECT symbol, '{resolution}' AS resolution, {bucket} AS ts, first(price ORDER BY ts, id) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, id) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2, 3)"""


def r6(name: str) -> str:
    return f"floor({name} * 1000000.0 + 0.5) / 1000000.0 AS {name}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: S.js_round(F.col(n), 6) for n in names})


def hourly(spark, d) -> DataFrame:
    return B.build_bars(T.ticks(spark, d), "60")


BARS = "WITH " + bars_sql()
W = "PARTITION BY symbol, resolution ORDER BY ts"
COLUMNS = "symbol, resolution, ts, open, high, low, close, volume"


@query("bar3_build_bars", f"{BARS} SELECT {COLUMNS} FROM bars")
def build_bars(spark, d):
    return hourly(spark, d)


@query("bar3_build_bars_by_user", f"WITH {bars_sql('240', key='user_id::VARCHAR')} SELECT {COLUMNS} FROM bars")
def build_bars_by_user(spark, d):
    return B.build_bars(T.ticks(spark, d, "user_id"), "240")


def _resampled(code: str, bucket: str) -> str:
    return f"""SELECT symbol, '{code}' AS resolution, {bucket} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2, 3"""


@query(
    "bar4_resample",
    f"""{BARS} {_resampled('240', "time_bucket(INTERVAL '240 minutes', ts)")} UNION ALL {_resampled('D', "date_trunc('day', ts)::TIMESTAMP")}
UNION ALL {_resampled('W', "date_trunc('week', ts)::TIMESTAMP")} UNION ALL {_resampled('M', "date_trunc('month', ts)::TIMESTAMP")}""",
)
def resample(spark, d):
    out = [B.resample(hourly(spark, d), code) for code in ("240", "D", "W", "M")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "bar1_last_n_bars",
    f"""{BARS} SELECT {COLUMNS}, total_available FROM (SELECT *, row_number() OVER (PARTITION BY symbol, resolution ORDER BY ts DESC) AS r,
  count(*) OVER (PARTITION BY symbol, resolution) AS total_available FROM bars) WHERE r <= 50""",
)
def last_n_bars(spark, d):
    return B.last_n_bars(hourly(spark, d), 50)


NUMBER = r"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '')"
SUMMARY = f"""newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, resolution ORDER BY ts DESC) AS r FROM bars) WHERE r <= 100),
s AS (SELECT symbol, resolution, count(*) AS bar_count, min(ts) AS period_from, max(ts) AS period_to, first(open ORDER BY ts) AS open, last(close ORDER BY ts) AS close,
  max(high) AS high, min(low) AS low, floor(avg(volume) + 0.5) AS avg_volume,
  string_agg(CAST(CAST(close AS DECIMAL(18,4)) AS VARCHAR), ' ' ORDER BY ts) FILTER (r <= 5) AS last_closes FROM newest GROUP BY 1, 2),
summary AS (SELECT *, floor((high - low) * 100 + 0.5) / 100 AS range, floor((close - open) * 100 + 0.5) / 100 AS change,
  {NUMBER.format(x="floor((close - open) / nullif(open, 0) * 100 * 100 + 0.5) / 100")} || '%' AS change_pct FROM s)"""


def _closes(df: DataFrame) -> DataFrame:
    """The five bars as a text of closes."""
    return df.withColumn("last_closes", F.array_join(F.transform("last_5_bars", lambda b: b["close"].cast("decimal(18,4)").cast("string")), " ")).drop("last_5_bars")


@query("bar2_ohlcv_summary", f"{BARS}, {SUMMARY} SELECT * FROM summary")
def ohlcv_summary(spark, d):
    return _closes(B.ohlcv_summary(hourly(spark, d), 100))


@query(
    "bar5_resolution_seconds",
    """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'D' WHEN p_size % 5 = 1 THEN '1W' WHEN p_size % 5 = 2 THEN 'M' ELSE p_size::VARCHAR END AS code FROM part)
SELECT p_partkey, code, CASE code WHEN 'D' THEN 86400 WHEN '1W' THEN 604800 WHEN 'M' THEN 2592000 ELSE TRY_CAST(code AS BIGINT) * 60 END::BIGINT AS seconds FROM c""",
)
def resolution_seconds(spark, d):
    size = F.col("p_size")
    code = F.when(size % 5 == 0, "D").when(size % 5 == 1, "1W").when(size % 5 == 2, "M").otherwise(size.cast("string"))
    return T.table(spark, d, "part").select("p_partkey", code.alias("code"), S.resolution_seconds(code).cast("long").alias("seconds"))


def symbols(spark, d) -> DataFrame:
    """The symbols of events and one that has no bars."""
    return T.ticks(spark, d).select("symbol").distinct().unionByName(T.table(spark, d, "region").select(F.concat(F.lit("none:"), "r_name").alias("symbol")))


SYMBOLS = "symbols AS (SELECT DISTINCT symbol FROM ticks UNION ALL SELECT 'none:' || r_name FROM region)"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, resolution ORDER BY ts DESC) AS r FROM bars) WHERE r = 1)"


@query(
    "bar6_quote_snapshot",
    f"""{BARS}, {SYMBOLS}, {LATEST} SELECT s.symbol, ts, open, high, low, close, volume, close AS last,
  CASE WHEN coalesce(close, 0) = 0 THEN 'Could not retrieve quote' END AS error FROM symbols s LEFT JOIN latest l ON s.symbol = l.symbol""",
)
def quote_snapshot(spark, d):
    return B.quote_snapshot(hourly(spark, d), symbols(spark, d))


@query(
    "bar7_pane_snapshot",
    f"""WITH {bars_sql()}, {SYMBOLS}, {LATEST}, panes AS (SELECT substr(symbol, 1, 1) AS layout, symbol AS pane_index, symbol, '60' AS resolution FROM symbols)
SELECT layout, pane_index, p.symbol, p.resolution, ts, open, high, low, close, volume, CASE WHEN ts IS NULL THEN 'no bars' END AS error,
  count(*) OVER (PARTITION BY layout) AS pane_count FROM panes p LEFT JOIN latest l ON p.symbol = l.symbol AND p.resolution = l.resolution""",
)
def pane_snapshot(spark, d):
    panes = symbols(spark, d).select(F.substring("symbol", 1, 1).alias("layout"), F.col("symbol").alias("pane_index"), "symbol", F.lit("60").alias("resolution"))
    return B.pane_snapshot(panes, hourly(spark, d))


@query(
    "bar8_heikin_ashi",
    f"""{BARS}, h AS (SELECT *, (open + high + low + close) / 4 AS ha_close, first_value((open + close) / 2) OVER ({W}) AS seed FROM bars),
l AS (SELECT *, list(ha_close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
o AS (SELECT *, list_reduce(list_prepend(seed, coalesce(before, [])), lambda y, x: (y + x) / 2) AS ha_open FROM l)
SELECT symbol, resolution, ts, {r6('ha_close')}, {r6('ha_open')}, floor(greatest(high, ha_open, ha_close) * 1000000.0 + 0.5) / 1000000.0 AS ha_high,
  floor(least(low, ha_open, ha_close) * 1000000.0 + 0.5) / 1000000.0 AS ha_low FROM o""",
)
def heikin_ashi(spark, d):
    return rounded(_heikin(hourly(spark, d)), "ha_open", "ha_high", "ha_low", "ha_close")


def _heikin(bars: DataFrame) -> DataFrame:
    return I.heikin_ashi(bars).select("symbol", "resolution", "ts", "ha_open", "ha_high", "ha_low", "ha_close")


@query("bar11_bar_index", f"{BARS} SELECT {COLUMNS}, (row_number() OVER ({W}) - 1)::INTEGER AS bar_index FROM bars")
def bar_index(spark, d):
    return B.bar_index(hourly(spark, d))


@query(
    "snk4_export_bars",
    f"""{BARS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, resolution ORDER BY ts DESC) AS r FROM bars) WHERE r <= 100)
SELECT symbol, resolution, count(*) AS bar_count, max(ts) AS last_ts, last(close ORDER BY ts) AS last_close FROM newest GROUP BY 1, 2""",
)
def export_bars(spark, d):
    return B.export_bars(hourly(spark, d)).select("symbol", "resolution", "bar_count", F.col("last_bar.ts").alias("last_ts"), F.col("last_bar.close").alias("last_close"))


@query(
    "src2_parse_candles",
    """SELECT event_id, date_trunc('milliseconds', ts) AS ts, value AS open, value + 1 AS high, value - 1 AS low, value AS close,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS volume FROM events""",
)
def parse_candles(spark, d):
    e = T.table(spark, d, "events")
    text = lambda c: c.cast("string")
    cells = [text(F.unix_millis(F.col("ts").cast("timestamp"))), text(F.col("value")), text(F.col("value") + 1), text(F.col("value") - 1), text(F.col("value")), F.get_json_object("props", "$.k")]
    payload = F.to_json(F.struct(F.array(F.array(*(F.coalesce(c, F.lit("")) for c in cells))).alias("data")))
    return B.candles(e.select("event_id", payload.alias("payload")))


@query("src1_read_bars", "SELECT event_id::VARCHAR AS symbol, ts, value AS close, 0.0::DOUBLE AS volume FROM events WHERE value IS NOT NULL AND ts IS NOT NULL")
def read_bars(spark, d):
    from .sources.files import clean_bars

    e = T.table(spark, d, "events")
    price = F.col("value")
    raw = e.select(F.col("event_id").cast("string").alias("symbol"), "ts", price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).alias("volume"))
    return clean_bars(raw).select("symbol", "ts", "close", "volume")


# Ranges and look-ups

FROM, TO = "2024-01-05 00:00:00", "2024-01-12 12:00:00"


@query("flt7_visible_range", f"{BARS} SELECT {COLUMNS} FROM bars WHERE ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def visible_range(spark, d):
    return M.visible_range(hourly(spark, d), FROM, TO)


@query(
    "flt8_around_date",
    f"""{BARS}, anchors AS (SELECT symbol, ts AS anchor_ts FROM ticks)
SELECT a.symbol, anchor_ts, ts, close FROM bars b JOIN anchors a ON a.symbol = b.symbol WHERE abs(floor(epoch(ts)) - floor(epoch(anchor_ts))) <= 90000""",
)
def around_date(spark, d):
    anchors = T.ticks(spark, d).select("symbol", F.col("ts").alias("anchor_ts"))
    return M.around_date(hourly(spark, d), anchors, 3600).select("symbol", "anchor_ts", "ts", "close")


@query(
    "flt8_around_date_all",
    f"""{BARS} SELECT a.symbol, a.ts AS anchor_ts, b.ts, close FROM bars b JOIN ticks a ON a.symbol = b.symbol
WHERE abs(floor(epoch(b.ts)) - floor(epoch(a.ts))) <= 90000""",
)
def around_date_all(spark, d):
    """Every tick is an anchor."""
    anchors = T.ticks(spark, d).select("symbol", F.col("ts").alias("anchor_ts"))
    return M.around_date(hourly(spark, d), anchors, 3600).select("symbol", "anchor_ts", "ts", "close")


@query(
    "jn1_watchlist_scan",
    f"""{BARS}, {SYMBOLS}, {LATEST} SELECT s.symbol, resolution, ts, open, high, low, close, volume, CASE WHEN close IS NULL THEN 'no bars' END AS error
FROM symbols s LEFT JOIN latest l ON s.symbol = l.symbol""",
)
def watchlist_scan(spark, d):
    return M.watchlist_scan(symbols(spark, d), hourly(spark, d))


GRID = f"""{SYMBOLS}, grid AS (SELECT symbol, unnest(['60', '15', 'D']) AS resolution FROM symbols),
res AS (SELECT symbol, resolution, count(*) AS n FROM bars GROUP BY 1, 2)"""


def _grid(spark, d) -> DataFrame:
    counts = hourly(spark, d).groupBy("symbol", "resolution").agg(F.count(F.lit(1)).alias("n"))
    return M.scan_grid(symbols(spark, d), ["60", "15", "D"], counts)


@query(
    "jn2_scan_grid",
    f"""{BARS}, {GRID} SELECT g.symbol, g.resolution, n, n IS NOT NULL AS success, CASE WHEN n IS NULL THEN 'no data' END AS error
FROM grid g LEFT JOIN res r ON g.symbol = r.symbol AND g.resolution = r.resolution""",
)
def scan_grid(spark, d):
    return _grid(spark, d)


@query(
    "agg16_batch_totals",
    f"""{BARS}, {GRID} SELECT count(*) AS total_iterations, count(n) AS successful, count(*) - count(n) AS failed
FROM grid g LEFT JOIN res r ON g.symbol = r.symbol AND g.resolution = r.resolution""",
)
def batch_totals(spark, d):
    return M.batch_totals(_grid(spark, d))


@query(
    "jn3_order_fills",
    """WITH f AS (SELECT l_orderkey, first(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 0 GROUP BY 1)
SELECT o_orderkey AS order_id, coalesce(q, 0.0) AS filled_qty FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""",
)
def order_fills(spark, d):
    line = T.table(spark, d, "lineitem")
    fills = line.select(F.col("l_orderkey").alias("order_id"), F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity")).alias("qty"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("attempt"))
    return M.order_fills(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id")), fills)


@query(
    "jn4_account_value",
    """SELECT o_custkey AS account, floor(sum(o_totalprice * CASE o_orderstatus WHEN 'O' THEN 79.0 WHEN 'F' THEN 70.0 ELSE 0.0 END) * 100 + 0.5) / 100 AS total_value
FROM orders GROUP BY 1""",
)
def account_value(spark, d):
    o = T.table(spark, d, "orders")
    prices = o.select(F.col("o_orderstatus").alias("coin")).distinct().where("coin <> 'P'").withColumn("price", F.ascii("coin").cast("double"))
    out = M.account_value(o.select(F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("coin"), F.col("o_totalprice").alias("qty")), prices)
    return out.withColumn("total_value", S.js_round(F.col("total_value"), 2))


@query("jn5_new_entities", "SELECT c_custkey AS id, 'removed' AS change FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def new_entities(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    gone = M.removed_entities(c, o).withColumn("change", F.lit("removed"))
    return gone.unionByName(M.new_entities(c.where("id % 3 = 0"), o).withColumn("change", F.lit("new")))


@query(
    "jn6_asof_bars",
    f"""WITH {bars_sql('240')}, t AS (SELECT symbol, ts, id, price FROM ticks) SELECT t.symbol, t.ts, t.id, b.close FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts >= b.ts""",
)
def asof_bars(spark, d):
    t = T.ticks(spark, d)
    return M.asof_join(t.select("symbol", "ts", "id"), B.build_bars(t, "240").select("symbol", F.col("ts").alias("at"), "close"), "symbol", "ts", "at", ["close"])


@query(
    "jn7_htf_align",
    f"""WITH {bars_sql()}, h AS (SELECT symbol, time_bucket(INTERVAL '240 minutes', ts) + INTERVAL '240 minutes' AS usable, last(close ORDER BY ts) AS htf_close FROM bars GROUP BY 1, 2)
SELECT b.symbol, b.ts, b.close, h.htf_close FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.usable""",
)
def htf_align(spark, d):
    low = hourly(spark, d)
    high = B.resample(low, "240").select("symbol", "ts", F.col("close").alias("htf_close"))
    return M.htf_align(low.select("symbol", "ts", "close"), high, 240 * 60, ["htf_close"])


LEVELS = "levels AS (SELECT DISTINCT symbol, floor(high + 0.5) AS level FROM bars)"


def _levels(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", S.js_round(F.col("high")).alias("level")).distinct()


@query(
    "jn8_nearest_level",
    f"""{BARS}, {LATEST}, {LEVELS}, q AS (SELECT symbol, close AS last FROM latest),
n AS (SELECT q.symbol, first(level ORDER BY abs(level - last), -level) AS key_level, max(level) FILTER (level <= last) AS support, min(level) FILTER (level > last) AS resistance
  FROM q JOIN levels l ON q.symbol = l.symbol GROUP BY 1) SELECT q.symbol, last, key_level, support, resistance FROM q LEFT JOIN n ON q.symbol = n.symbol""",
)
def nearest_level(spark, d):
    bars = hourly(spark, d)
    return M.nearest_level(B.latest_bars(bars).select("symbol", F.col("close").alias("last")), _levels(bars))


@query(
    "jn9_zone_touch",
    f"""{BARS}, z AS (SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS week, floor(avg(high)) AS zone_high, floor(avg(low)) AS zone_low FROM bars GROUP BY 1, 2)
SELECT z.symbol, week, count(*) AS touches, min(ts) AS first_touch FROM bars b JOIN z ON b.symbol = z.symbol WHERE low <= zone_high AND high >= zone_low GROUP BY 1, 2""",
)
def zone_touch(spark, d):
    bars = hourly(spark, d)
    zones = bars.groupBy("symbol", B.bucket("ts", "W").alias("week")).agg(F.floor(F.avg("high")).alias("zone_high"), F.floor(F.avg("low")).alias("zone_low"))
    return M.zone_touch(bars, zones).groupBy("symbol", "week").agg(F.count(F.lit(1)).alias("touches"), F.min("ts").alias("first_touch"))


@query(
    "jn10_eval_alerts",
    f"""{BARS}, a AS (SELECT id AS alert_id, symbol, price, ts AS created, ts + INTERVAL '3 days' AS expiration, CASE id % 3 WHEN 0 THEN 'crossing' WHEN 1 THEN 'greater_than' ELSE 'less_than' END AS condition
  FROM ticks WHERE id % 7 <> 0),
b AS (SELECT symbol, ts, close, lag(close) OVER ({W}) AS prev FROM bars),
f AS (SELECT alert_id, min(b.ts) AS fired_ts FROM a JOIN b ON a.symbol = b.symbol WHERE b.ts >= created AND b.ts <= expiration AND CASE condition
  WHEN 'crossing' THEN (prev < price AND close >= price) OR (prev > price AND close <= price) WHEN 'greater_than' THEN close > price ELSE close < price END GROUP BY 1)
SELECT a.alert_id, a.symbol, condition, price, fired_ts FROM a LEFT JOIN f ON a.alert_id = f.alert_id""",
)
def eval_alerts(spark, d):
    alerts = _alerts(T.ticks(spark, d)).withColumn("active", F.col("alert_id") % 7 != 0)
    return M.eval_alerts(hourly(spark, d), alerts).select("alert_id", "symbol", "condition", "price", "fired_ts")


def _alerts(t: DataFrame) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, "crossing").when(F.col("id") % 3 == 1, "greater_than").otherwise("less_than")
    return t.select(F.col("id").alias("alert_id"), "symbol", "price", F.col("ts").alias("created"), (F.col("ts") + F.expr("INTERVAL '3' DAY")).alias("expiration"), kind.alias("condition"), F.lit(True).alias("active"))


@query(
    "jn10_eval_alerts_all",
    f"""{BARS}, a AS (SELECT id AS alert_id, symbol, price, ts AS created, ts + INTERVAL '3 days' AS expiration, CASE id % 3 WHEN 0 THEN 'crossing' WHEN 1 THEN 'greater_than' ELSE 'less_than' END AS condition FROM ticks),
b AS (SELECT symbol, ts, close, lag(close) OVER ({W}) AS prev FROM bars),
f AS (SELECT alert_id, min(b.ts) AS fired_ts FROM a JOIN b ON a.symbol = b.symbol WHERE b.ts >= created AND b.ts <= expiration AND CASE condition
  WHEN 'crossing' THEN (prev < price AND close >= price) OR (prev > price AND close <= price) WHEN 'greater_than' THEN close > price ELSE close < price END GROUP BY 1)
SELECT a.alert_id, a.symbol, condition, price, fired_ts FROM a LEFT JOIN f ON a.alert_id = f.alert_id""",
)
def eval_alerts_all(spark, d):
    """Every tick is an active alert."""
    return M.eval_alerts(hourly(spark, d), _alerts(T.ticks(spark, d))).select("alert_id", "symbol", "condition", "price", "fired_ts")


@query(
    "jn11_pair_correlation",
    f"""{BARS}, r AS (SELECT symbol, resolution, ts, (close - p) / nullif(p, 0) AS ret FROM (SELECT *, lag(close) OVER ({W}) AS p FROM bars)), s AS (SELECT * FROM r WHERE ret IS NOT NULL)
SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.resolution, count(*) AS n, floor(corr(a.ret, b.ret) * 1000000.0 + 0.5) / 1000000.0 AS corr
FROM s a JOIN s b ON a.resolution = b.resolution AND a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
def pair_correlation(spark, d):
    return rounded(M.pair_correlation(hourly(spark, d)), "corr")


@query(
    "jn11_relative_strength",
    f"""{BARS}, n AS (SELECT count(DISTINCT symbol) AS k FROM bars), c AS (SELECT ts FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT k FROM n) ORDER BY ts DESC LIMIT 20),
e AS (SELECT symbol, resolution, first(close ORDER BY ts) AS first_close, last(close ORDER BY ts) AS last_close FROM bars WHERE ts IN (SELECT ts FROM c) GROUP BY 1, 2),
q AS (SELECT *, (last_close - first_close) / nullif(first_close, 0) AS ret FROM e) SELECT *, rank() OVER (PARTITION BY resolution ORDER BY ret DESC NULLS LAST)::INTEGER AS rank FROM q""",
)
def relative_strength(spark, d):
    return M.relative_strength(hourly(spark, d), 20)


@query("jn12_watchlist_add", f"WITH {TICKS.format(key='event_type')}, {SYMBOLS} SELECT symbol FROM symbols")
def watchlist_add(spark, d):
    known = T.ticks(spark, d).select("symbol").distinct()
    return M.watchlist_add(known, symbols(spark, d))


# Indicators


@query("agg1_vwap", f"{BARS} SELECT symbol, resolution, floor(CASE WHEN sum(volume) = 0 THEN last(close ORDER BY ts) ELSE sum((high + low + close) / 3 * volume) / sum(volume) END * 1000000.0 + 0.5) / 1000000.0 AS vwap FROM bars GROUP BY 1, 2")
def vwap(spark, d):
    return rounded(I.vwap(hourly(spark, d)), "vwap")


DAY = "PARTITION BY symbol, resolution, ts::DATE ORDER BY ts"


@query(
    "agg1_session_vwap",
    f"""{BARS}, v AS (SELECT symbol, ts, close, sum((high + low + close) / 3 * volume) OVER ({DAY} ROWS UNBOUNDED PRECEDING) AS a, sum(volume) OVER ({DAY} ROWS UNBOUNDED PRECEDING) AS b FROM bars)
SELECT symbol, ts, floor(CASE WHEN b = 0 THEN close ELSE a / b END * 1000000.0 + 0.5) / 1000000.0 AS session_vwap FROM v""",
)
def session_vwap(spark, d):
    return rounded(I.session_vwap(hourly(spark, d)).select("symbol", "ts", "session_vwap"), "session_vwap")


LAST30 = f"({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
SCALPER = f"""x AS (SELECT *, list(close) OVER {LAST30} AS cs, close - lag(close) OVER ({W}) AS diff, row_number() OVER ({W}) AS n,
  sum((high + low + close) / 3 * volume) OVER {LAST30} AS tv, sum(volume) OVER {LAST30} AS vol FROM bars),
y AS (SELECT *, list_reduce(cs, lambda acc, c: c * (2.0::DOUBLE / 9) + acc * (1 - 2.0::DOUBLE / 9)) AS ema8,
  sum(greatest(diff, 0)) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g, sum(greatest(-diff, 0)) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l,
  CASE WHEN vol = 0 THEN close ELSE tv / vol END AS vwap FROM x),
z AS (SELECT *, CASE WHEN n <= 3 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi3 FROM y),
sig AS (SELECT *, CASE WHEN close > vwap AND close > ema8 AND rsi3 < 30 THEN 'buy' WHEN close < vwap AND close < ema8 AND rsi3 > 70 THEN 'sell' ELSE 'flat' END AS signal FROM z)"""


@query("ind1_ema_trailing", f"{BARS}, {SCALPER} SELECT symbol, ts, {r6('ema8')} FROM sig")
def ema_trailing(spark, d):
    return rounded(I.ema(hourly(spark, d), 8).select("symbol", "ts", "ema8"), "ema8")


@query("ind2_rsi_simple", f"{BARS}, {SCALPER} SELECT symbol, ts, {r6('rsi3')} FROM sig")
def rsi_simple(spark, d):
    return rounded(I.rsi_simple(hourly(spark, d), 3).select("symbol", "ts", "rsi3"), "rsi3")


@query(
    "ind4_ind6_bollinger",
    f"""{BARS}, b AS (SELECT symbol, ts, CASE WHEN row_number() OVER ({W}) >= 20 THEN avg(close) OVER w END AS sma20, CASE WHEN row_number() OVER ({W}) >= 20 THEN stddev_pop(close) OVER w END AS s,
  CASE WHEN row_number() OVER ({W}) >= 20 THEN avg(volume) OVER w END AS volume_ma FROM bars WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT symbol, ts, sma20, sma20 AS bb_mid, sma20 + 2 * s AS bb_upper, sma20 - 2 * s AS bb_lower, volume_ma FROM b)
SELECT symbol, ts, {r6('sma20')}, {r6('bb_mid')}, {r6('bb_upper')}, {r6('bb_lower')}, {r6('volume_ma')} FROM c""",
)
def bollinger(spark, d):
    out = I.volume_ma(I.bollinger(I.sma(hourly(spark, d), 20), 20, 2.0), 20)
    return rounded(out.select("symbol", "ts", "sma20", "bb_mid", "bb_upper", "bb_lower", "volume_ma"), "sma20", "bb_mid", "bb_upper", "bb_lower", "volume_ma")


@query("ind8_rolling_vwap", f"{BARS}, {SCALPER} SELECT symbol, ts, {r6('vwap')} FROM sig")
def rolling_vwap(spark, d):
    return rounded(I.rolling_vwap(hourly(spark, d)).select("symbol", "ts", "vwap"), "vwap")


@query(
    "ind10_pct_change",
    f"""{BARS}, p AS (SELECT *, lag(close) OVER ({W}) AS b FROM bars) SELECT symbol, ts, (close - b) * 100 / nullif(b, 0) AS pct_change,
  CASE WHEN close > b THEN 'up' WHEN close < b THEN 'down' ELSE 'flat' END AS momentum FROM p""",
)
def pct_change(spark, d):
    return I.pct_change(hourly(spark, d)).select("symbol", "ts", "pct_change", "momentum")


UPTO = f"({W} ROWS UNBOUNDED PRECEDING)"


def full_ema(column: str, n: int) -> str:
    k = f"(2.0::DOUBLE / {n + 1})"
    return f"list_reduce(list({column}) OVER {UPTO}, lambda acc, c: c * {k} + acc * (1 - {k}))"


def full_wilder(column: str, n: int, skip: int) -> str:
    """From a list of values so far, whose first skip are left out."""
    m = n - 1
    return f"""CASE WHEN len({column}) - {skip} >= {n} THEN list_reduce(list_prepend(list_avg({column}[{skip + 1}:{skip + n}]), {column}[{skip + n + 1}:]), lambda acc, c: (acc * {m} + c) / {n}) END"""


RSI14 = f"""d1 AS (SELECT *, close - lag(close) OVER ({W}) AS diff FROM bars),
d2 AS (SELECT *, list(coalesce(greatest(diff, 0), 0)) OVER {UPTO} AS ups, list(coalesce(greatest(-diff, 0), 0)) OVER {UPTO} AS downs FROM d1),
d3 AS (SELECT *, {full_wilder('ups', 14, 1)} AS gain, {full_wilder('downs', 14, 1)} AS loss FROM d2),
rsi AS (SELECT * EXCLUDE (diff, ups, downs, gain, loss), CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi14 FROM d3)"""


@query("ind3_rsi_wilder", f"{BARS}, {RSI14} SELECT symbol, ts, {r6('rsi14')} FROM rsi")
def rsi_wilder(spark, d):
    return rounded(I.rsi_wilder(hourly(spark, d), 14).select("symbol", "ts", "rsi14"), "rsi14")


@query(
    "ind5_macd",
    f"""{BARS}, e AS (SELECT *, {full_ema('close', 12)} - {full_ema('close', 26)} AS macd_line FROM bars), s AS (SELECT *, {full_ema('macd_line', 9)} AS signal_line FROM e),
h AS (SELECT symbol, ts, macd_line, signal_line, macd_line - signal_line AS macd_histogram FROM s) SELECT symbol, ts, {r6('macd_line')}, {r6('signal_line')}, {r6('macd_histogram')} FROM h""",
)
def macd(spark, d):
    return rounded(I.macd(hourly(spark, d)).select("symbol", "ts", "macd_line", "signal_line", "macd_histogram"), "macd_line", "signal_line", "macd_histogram")


@query(
    "ind7_atr",
    f"""{BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars), l AS (SELECT *, list(tr) OVER {UPTO} AS trs FROM t),
a AS (SELECT symbol, ts, {full_wilder('trs', 14, 0)} AS atr14 FROM l) SELECT symbol, ts, {r6('atr14')} FROM a""",
)
def atr(spark, d):
    return rounded(I.atr(hourly(spark, d), 14).select("symbol", "ts", "atr14"), "atr14")


RIBBON = f"""rib AS (SELECT *, {full_ema('close', 21)} AS ema21, {full_ema('close', 50)} AS ema50, {full_ema('close', 200)} AS ema200, {full_ema('close', 20)} AS ema20 FROM bars),
ribbon AS (SELECT *, CASE WHEN ema21 > ema50 AND ema50 > ema200 THEN 'up' WHEN ema21 < ema50 AND ema50 < ema200 THEN 'down' ELSE 'mixed' END AS ribbon FROM rib)"""


@query("ind9_ema_ribbon", f"{BARS}, {RIBBON} SELECT symbol, ts, {r6('ema21')}, {r6('ema50')}, {r6('ema200')}, ribbon FROM ribbon")
def ema_ribbon(spark, d):
    return rounded(I.ema_ribbon(hourly(spark, d)).select("symbol", "ts", "ema21", "ema50", "ema200", "ribbon"), "ema21", "ema50", "ema200")


# Signals


@query("sig1_scalper_signal", f"{BARS}, {SCALPER} SELECT symbol, ts, close, {r6('ema8')}, {r6('rsi3')}, {r6('vwap')}, signal FROM sig")
def scalper_signal(spark, d):
    """The flagship query: EMA, RSI, VWAP and the signal of every bar of every symbol."""
    out = G.scalper_signal(hourly(spark, d)).select("symbol", "ts", "close", "ema8", "rsi3", "vwap", "signal")
    return rounded(out, "ema8", "rsi3", "vwap")


@query(
    "sig2_momentum_signal",
    f"""{BARS}, {RSI14}, m AS (SELECT *, (close - lag(close) OVER ({W})) * 100 / nullif(lag(close) OVER ({W}), 0) AS pc FROM rsi)
SELECT symbol, ts, CASE WHEN rsi14 IS NULL OR rsi14 < 30 OR rsi14 > 70 OR pc IS NULL OR abs(pc) < 0.05 THEN 'neutral' WHEN pc > 0 THEN 'bullish' ELSE 'bearish' END AS bias FROM m""",
)
def momentum_signal(spark, d):
    return G.momentum_signal(hourly(spark, d)).select("symbol", "ts", "bias")


BIAS = f"""{RSI14}, {RIBBON}, bias AS (SELECT r.*, rsi14, CASE WHEN ribbon = 'mixed' OR rsi14 BETWEEN 45 AND 55 OR abs((r.close - ema20) / nullif(ema20, 0)) < 0.0005 OR rsi14 IS NULL THEN 'neutral'
  WHEN ribbon = 'up' AND r.close > ema20 AND rsi14 < 60 THEN 'bullish' WHEN ribbon = 'down' AND r.close < ema20 AND rsi14 > 40 THEN 'bearish' ELSE 'neutral' END AS bias
  FROM ribbon r JOIN rsi s ON r.symbol = s.symbol AND r.ts = s.ts)"""


@query("sig3_trend_bias", f"{BARS}, {BIAS} SELECT symbol, ts, ribbon, bias FROM bias")
def trend_bias(spark, d):
    return P.trend_bias(hourly(spark, d)).select("symbol", "ts", "ribbon", "bias")


@query(
    "sig3_trend_bias_4h",
    f"""{BARS}, {RSI14}, rib AS (SELECT *, {full_ema('close', 21)} AS ema21, {full_ema('close', 50)} AS ema50, {full_ema('close', 200)} AS ema200 FROM bars),
h AS (SELECT symbol, '240' AS resolution, time_bucket(INTERVAL '240 minutes', ts) AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY 1, 2, 3),
he AS (SELECT symbol, ts + INTERVAL '240 minutes' AS usable, {full_ema('close', 20)} AS ema20 FROM h),
r AS (SELECT rib.*, ema20, CASE WHEN ema21 > ema50 AND ema50 > ema200 THEN 'up' WHEN ema21 < ema50 AND ema50 < ema200 THEN 'down' ELSE 'mixed' END AS ribbon
  FROM rib ASOF LEFT JOIN he ON rib.symbol = he.symbol AND rib.ts >= he.usable)
SELECT r.symbol, r.ts, ribbon, CASE WHEN ribbon = 'mixed' OR rsi14 BETWEEN 45 AND 55 OR abs((r.close - ema20) / nullif(ema20, 0)) < 0.0005 OR rsi14 IS NULL OR ema20 IS NULL THEN 'neutral'
  WHEN ribbon = 'up' AND r.close > ema20 AND rsi14 < 60 THEN 'bullish' WHEN ribbon = 'down' AND r.close < ema20 AND rsi14 > 40 THEN 'bearish' ELSE 'neutral' END AS bias
FROM r JOIN rsi s ON r.symbol = s.symbol AND r.ts = s.ts""",
)
def trend_bias_4h(spark, d):
    bars = hourly(spark, d)
    return P.trend_bias(bars, B.resample(bars, "240")).select("symbol", "ts", "ribbon", "bias")


MACHINE = f"""p AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 'flat' THEN signal END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'sell') AS b FROM sig),
machine AS (SELECT *, CASE WHEN (signal = 'buy' AND b = 'sell') OR (signal = 'sell' AND b = 'buy') THEN signal ELSE 'skip' END AS action FROM p)"""
REASON = """CASE WHEN action <> 'skip' THEN NULL WHEN signal = 'flat' THEN 'no signal — conditions not met'
  ELSE 'signal=' || signal || ' but holding=' || CASE WHEN b = 'buy' THEN 'base' ELSE 'quote' END || ' (waiting for right side)' END"""


@query("sig4_position_machine", f"{BARS}, {SCALPER}, {MACHINE} SELECT symbol, ts, signal, action, {REASON} AS skip_reason FROM machine")
def position_machine(spark, d):
    return P.scalper_backtest(hourly(spark, d)).select("symbol", "ts", "signal", "action", "skip_reason")


@query(
    "sig5_order_size",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_totalprice % 3 >= 1 THEN printf('%.4f', (o_totalprice % 3) * 0.9)
  WHEN o_orderkey % 2 = 1 AND o_totalprice % 5 >= 1 THEN printf('%.4f', floor((o_totalprice % 5) * 10000) / 10000) END AS size FROM orders""",
)
def order_size(spark, d):
    o = T.table(spark, d, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_totalprice") % 3).alias("quote"), (F.col("o_totalprice") % 5).alias("base"))
    return G.order_size(rows).select("o_orderkey", "size")


@query("sig6_cap_trade_size", "SELECT o_orderkey, least(0.01::DOUBLE * (o_totalprice / 100), 3.0::DOUBLE) AS trade_size, o_totalprice % 7 >= 2 * (o_totalprice % 4) AS allowed FROM orders")
def cap_trade_size(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("portfolio"), (F.col("o_totalprice") % 7).alias("reward"), (F.col("o_totalprice") % 4).alias("risk"))
    return G.cap_trade_size(o).select("o_orderkey", "trade_size", "allowed")


@query(
    "sig7_safety_check",
    f"""{BARS}, {RSI14}, e AS (SELECT *, {full_ema('close', 21)} AS ema21, {full_ema('close', 50)} AS ema50, {full_ema('close', 200)} AS ema200, {full_ema('close', 12)} - {full_ema('close', 26)} AS m FROM bars),
s AS (SELECT *, {full_ema('m', 9)} AS sl FROM e),
t AS (SELECT s.symbol, s.ts, coalesce(s.close > ema200, false) AS a, coalesce(ema21 > ema50, false) AS b, coalesce(s.close BETWEEN least(ema21, ema50) AND greatest(ema21, ema50), false) AS c,
  coalesce(rsi14 BETWEEN 35 AND 58, false) AS d, coalesce(m > sl, false) AS e FROM s JOIN rsi ON s.symbol = rsi.symbol AND s.ts = rsi.ts)
SELECT symbol, ts, CASE WHEN a AND b AND c AND d AND e THEN 'ALLOWED' ELSE 'BLOCKED' END AS verdict, (5 - a::INT - b::INT - c::INT - d::INT - e::INT)::INTEGER AS failed FROM t""",
)
def safety_check(spark, d):
    bars = I.history(hourly(spark, d), emas={"ema21": 21, "ema50": 50, "ema200": 200, "_fast": 12, "_slow": 26}, rsi={"rsi14": 14}, leave_places=True)
    bars = I.macd_of(bars).withColumn("price", F.col("close"))
    return G.safety_check(bars).select("symbol", "ts", "verdict", F.size("blocked_reasons").alias("failed"))


@query("sig8_time_exit", f"WITH {TICKS.format(key='event_type')} SELECT symbol, id, price, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, id) AS exit_ts, lead(price) OVER (PARTITION BY symbol ORDER BY ts, id) AS exit_price FROM ticks")
def time_exit(spark, d):
    return G.time_exit(T.ticks(spark, d), "symbol", ("ts", "id")).select("symbol", "id", "price", "exit_ts", "exit_price")


@query(
    "sig10_order_outcome",
    """SELECT o_orderkey, o_orderstatus = 'F' AS order_placed, CASE WHEN o_orderstatus = 'F' THEN 'id' || o_orderkey ELSE o_custkey || '.5XRP can be used AT most' END AS order_ref,
  CASE WHEN o_orderstatus <> 'F' THEN o_custkey + 0.5::DOUBLE END AS locked_available FROM orders""",
)
def order_outcome(spark, d):
    o = T.table(spark, d, "orders")
    ok = F.col("o_orderstatus") == "F"
    log = o.select("o_orderkey", F.when(ok, "00000").otherwise("12001").alias("code"), F.when(~ok, F.concat(F.col("o_custkey").cast("string"), F.lit(".5XRP can be used AT most"))).alias("msg"), F.when(ok, F.concat(F.lit("id"), F.col("o_orderkey").cast("string"))).otherwise("").alias("order_id"))
    return G.order_outcome(log).select("o_orderkey", "order_placed", "order_ref", "locked_available")


# Workflows


BRIEF = f"""{BARS}, {SYMBOLS}, {LATEST}, {LEVELS}, {BIAS}, lb AS (SELECT symbol, last(bias ORDER BY ts) AS bias FROM bias GROUP BY 1), q AS (SELECT symbol, close AS last FROM latest),
n AS (SELECT q.symbol, first(level ORDER BY abs(level - last), -level) AS key_level, max(level) FILTER (level <= last) AS support, min(level) FILTER (level > last) AS resistance
  FROM q JOIN levels l ON q.symbol = l.symbol GROUP BY 1),
a AS (SELECT s.symbol, coalesce(lb.bias, 'neutral') AS bias, q.last, key_level, support, resistance FROM symbols s LEFT JOIN lb ON s.symbol = lb.symbol LEFT JOIN q ON s.symbol = q.symbol LEFT JOIN n ON s.symbol = n.symbol),
brief AS (SELECT symbol, bias, key_level, CASE WHEN last IS NULL THEN 'no bars' END AS error, CASE WHEN last IS NOT NULL THEN symbol || ' | BIAS: ' || bias || ' | KEY LEVEL: ' || coalesce({NUMBER.format(x='key_level')}, '-') || ' | WATCH: ' ||
  CASE bias WHEN 'bullish' THEN 'break of ' || {NUMBER.format(x='coalesce(resistance, last)')} WHEN 'bearish' THEN 'loss of ' || {NUMBER.format(x='coalesce(support, last)')} ELSE 'range' END END AS line FROM a)"""


@query("wf1_morning_brief", f"{BRIEF} SELECT * FROM brief")
def morning_brief(spark, d):
    bars = hourly(spark, d)
    return P.morning_brief(symbols(spark, d), bars, _levels(bars)).select("symbol", "bias", "key_level", "error", "line")


def _rules(spark, d) -> dict:
    """Rules of a file that Spark has written: all symbols from Z to A, hours."""
    from .sources.files import load_rules
    from .sources.scratch import new_folder

    path = new_folder(spark, "rules")
    listed = symbols(spark, d).agg(F.sort_array(F.collect_list("symbol"), asc=False).alias("watchlist"))
    criteria = F.struct(F.lit("ribbon up, close over the mean").alias("bullish"), F.lit("ribbon down, close under it").alias("bearish"))
    rules = listed.select("watchlist", F.lit("60").alias("default_timeframe"), criteria.alias("bias_criteria"), F.lit("").alias("notes"))
    rules.select(F.to_json(F.struct(*rules.columns)).alias("value")).coalesce(1).write.text(path)
    return load_rules(spark, [f"{path}-of-nobody", path])


@query("src3_load_rules", f"{BARS}, {SYMBOLS} SELECT symbol, (row_number() OVER (ORDER BY symbol DESC) - 1)::INTEGER AS seq, '60' AS timeframe FROM symbols")
def load_rules(spark, d):
    from .sources.files import watchlist

    rules = _rules(spark, d)
    return watchlist(spark, rules).withColumn("timeframe", F.lit(rules["default_timeframe"]))


@query("wf1_brief_of_rules", f"{BRIEF} SELECT (row_number() OVER (ORDER BY symbol DESC) - 1)::INTEGER AS seq, '60' AS timeframe, * FROM brief")
def brief_of_rules(spark, d):
    """The brief of the hours' bars, which lie beside those of days."""
    bars = hourly(spark, d)
    both = bars.unionByName(B.build_bars(T.ticks(spark, d), "D"))
    return P.brief_of_rules(spark, _rules(spark, d), both, _levels(bars)).select("seq", "timeframe", "symbol", "bias", "key_level", "error", "line")


@query(
    "wf1_brief_totals",
    f"""{BRIEF}, t AS (SELECT count(*) AS scanned, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL AND bias = 'bullish') AS bullish,
  count(*) FILTER (error IS NULL AND bias = 'bearish') AS bearish, count(*) FILTER (error IS NULL AND bias = 'neutral') AS neutral FROM brief)
SELECT *, 'OVERALL: ' || CASE WHEN bullish > bearish THEN 'bullish' WHEN bearish > bullish THEN 'bearish' ELSE 'neutral' END || ' (' || bullish || ' bullish, ' || bearish || ' bearish, ' || neutral || ' neutral)' AS overall FROM t""",
)
def brief_totals(spark, d):
    bars = hourly(spark, d)
    return P.brief_totals(P.morning_brief(symbols(spark, d), bars, _levels(bars)))


@query(
    "wf3_batch_scan",
    f"""{BARS}, {SYMBOLS}, {SUMMARY}, grid AS (SELECT symbol, unnest(['60', 'D']) AS resolution FROM symbols)
SELECT g.symbol, g.resolution, bar_count, change_pct, bar_count IS NOT NULL AS success, CASE WHEN bar_count IS NULL THEN 'no data' END AS error FROM grid g LEFT JOIN summary s ON g.symbol = s.symbol AND g.resolution = s.resolution""",
)
def batch_scan(spark, d):
    return P.batch_scan(symbols(spark, d), ["60", "D"], hourly(spark, d)).select("symbol", "resolution", "bar_count", "change_pct", "success", "error")


@query(
    "wf3_batch_scan_strategy",
    """WITH t AS (SELECT l_suppkey::VARCHAR AS symbol, CASE WHEN l_linestatus = 'O' THEN '60' ELSE 'D' END AS resolution, CAST(floor(l_extendedprice * (l_tax - l_discount) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS pnl FROM lineitem),
m AS (SELECT symbol, resolution, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, CAST(sum(pnl) AS DOUBLE) AS net_profit FROM t WHERE symbol::BIGINT % 3 <> 0 OR resolution = 'D' GROUP BY 1, 2),
g AS (SELECT DISTINCT symbol, unnest(['60', 'D', '240']) AS resolution FROM t)
SELECT g.symbol, g.resolution, total_trades, wins, net_profit, total_trades IS NOT NULL AS success, CASE WHEN total_trades IS NULL THEN 'no data' END AS error FROM g LEFT JOIN m ON g.symbol = m.symbol AND g.resolution = m.resolution""",
)
def batch_scan_strategy(spark, d):
    """Longs as trades of hours, shorts as those of days; a third of the symbols has no longs, and none has trades of four hours."""
    trades = T.trades(spark, d).select(F.col("strategy").alias("symbol"), F.when(F.col("side") == "long", "60").otherwise("D").alias("resolution"), "pnl")
    known = trades.where((F.col("symbol").cast("long") % 3 != 0) | (F.col("resolution") == "D"))
    out = P.batch_scan(trades.select("symbol").distinct(), ["60", "D", "240"], None, "strategy", known)
    return out.select("symbol", "resolution", "total_trades", "wins", "net_profit", "success", "error")


@query("wf3_batch_scan_unknown", f"{BARS}, {SYMBOLS} SELECT symbol, unnest(['60', 'D']) AS resolution, false AS success, 'Unknown action: screenshot' AS error FROM symbols")
def batch_scan_unknown(spark, d):
    return P.batch_scan(symbols(spark, d), ["60", "D"], hourly(spark, d), "screenshot").select("symbol", "resolution", "success", "error")


@query("wf5_scalper_backtest", f"{BARS}, {SCALPER}, {MACHINE} SELECT symbol, resolution, count(*) AS ticks, count(*) FILTER (action <> 'skip') AS placed, last(close ORDER BY ts) AS last_price FROM machine GROUP BY 1, 2")
def scalper_backtest(spark, d):
    return P.backtest_totals(P.scalper_backtest(hourly(spark, d)))


@query("win8_replay_step", f"{BARS}, r AS (SELECT *, row_number() OVER ({W}) AS n FROM bars WHERE ts >= TIMESTAMP '{FROM}') SELECT k.symbol, ts, close, CASE WHEN ts IS NULL THEN 'no bar at or after the date' END AS error FROM (SELECT DISTINCT symbol FROM bars) k LEFT JOIN r ON k.symbol = r.symbol AND n = 4")
def replay_step(spark, d):
    return P.replay_step(hourly(spark, d), FROM, 3).select("symbol", "ts", "close", "error")


DAILY = f"""WITH {bars_sql('D', "date_trunc('day', ts)::TIMESTAMP")}, s AS (SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN close > open THEN 'bullish' WHEN close < open THEN 'bearish' ELSE 'neutral' END AS bias FROM bars)"""


def _sessions(spark, d) -> DataFrame:
    day = B.build_bars(T.ticks(spark, d), "D")
    bias = F.when(F.col("close") > F.col("open"), "bullish").when(F.col("close") < F.col("open"), "bearish").otherwise("neutral")
    return day.select("symbol", S.date_key(F.col("ts")).alias("date"), bias.alias("bias"))


@query("win7_day_over_day", f"{DAILY}, l AS (SELECT *, lag(bias) OVER (PARTITION BY symbol ORDER BY date) AS previous_bias FROM s) SELECT *, coalesce(previous_bias <> bias, false) AS changed FROM l")
def day_over_day(spark, d):
    return P.day_over_day(_sessions(spark, d))


@query("wf2_get_session", f"{DAILY}, b AS (SELECT date, string_agg(symbol || ':' || bias, ' ' ORDER BY symbol) AS brief FROM s GROUP BY 1) SELECT date, brief, CASE WHEN date <> '2024-01-10' THEN 'no session for 2024-01-10; this is an earlier one' END AS note FROM b WHERE date IN ('2024-01-10', '2024-01-09') ORDER BY date DESC LIMIT 1")
def get_session(spark, d):
    text = F.array_join(F.sort_array(F.collect_list(F.concat("symbol", F.lit(":"), "bias"))), " ")
    return P.get_session(_sessions(spark, d).groupBy("date").agg(text.alias("brief")), "2024-01-10")


@query("snk2_merge_sessions", f"{DAILY}, b AS (SELECT date, min(bias) AS brief, count(*) AS extra FROM s GROUP BY 1) SELECT date, CASE WHEN date >= '2024-01-08' THEN 'new' ELSE 'old' END AS saved_at, CASE WHEN date >= '2024-01-08' THEN max_bias ELSE brief END AS brief, CASE WHEN date < '2024-01-15' THEN extra END AS extra FROM b JOIN (SELECT date, max(bias) AS max_bias FROM s GROUP BY 1) USING (date)")
def merge_sessions(spark, d):
    from .sources.files import merge_sessions as merge

    by_date = _sessions(spark, d).groupBy("date").agg(F.min("bias").alias("old"), F.max("bias").alias("new"), F.count(F.lit(1)).alias("extra"))
    stored = by_date.where("date < '2024-01-15'").select("date", F.lit("old").alias("saved_at"), F.col("old").alias("brief"), "extra")
    return merge(stored, by_date.where("date >= '2024-01-08'").select("date", F.lit("new").alias("saved_at"), F.col("new").alias("brief")))


# Streams: their batch twins


@query("st1_changes_only", f"WITH {TICKS.format(key='event_type')}, c AS (SELECT symbol, ts, id, floor(price / 10)::BIGINT AS level FROM ticks), l AS (SELECT *, lag(level) OVER (PARTITION BY symbol ORDER BY ts, id) AS b FROM c WHERE level IS NOT NULL) SELECT symbol, ts, id, level FROM l WHERE b IS NULL OR b <> level")
def changes_only(spark, d):
    t = T.ticks(spark, d).select("symbol", "ts", "id", F.floor(F.col("price") / 10).alias("level"))
    return X.changes_only_batch(t, ["symbol"], ["level"], ["ts", "id"])


@query("st2_sample_latest", f"WITH {TICKS.format(key='event_type')} SELECT symbol, time_bucket(INTERVAL '500 milliseconds', ts) AS sampled_at, last(price ORDER BY ts, id) AS price, last(id ORDER BY ts, id) AS id FROM ticks GROUP BY 1, 2")
def sample_latest(spark, d):
    return X.sample_latest(T.ticks(spark, d), ["symbol"], X.INTERVALS["bars"], ["price", "id"], "id")


@query("st3_stream_bars", f"{BARS}, l AS (SELECT *, lag(ts) OVER ({W}) AS b FROM bars) SELECT {COLUMNS}, b IS NULL OR b <> ts AS new_bar FROM l")
def stream_bars(spark, d):
    return X.stream_bars_batch(hourly(spark, d))


@query("st3_stream_quotes", f"{BARS}, l AS (SELECT *, lag((open, high, low, close, volume)) OVER ({W}) AS b FROM bars) SELECT {COLUMNS} FROM l WHERE b IS NULL OR b IS DISTINCT FROM (open, high, low, close, volume)")
def stream_quotes(spark, d):
    return X.stream_quotes_batch(hourly(spark, d))


@query(
    "st4_stream_values",
    f"WITH {TICKS.format(key='event_type')}, v AS (SELECT symbol, 's' || (id % 3) AS study, 'k' AS title, size AS value, id AS seq FROM ticks WHERE id % 4 <> 0), l AS (SELECT *, lag(value) OVER (PARTITION BY symbol, study, title ORDER BY seq) AS b FROM v) SELECT symbol, study, title, value, seq FROM l WHERE b IS NULL OR b <> value",
)
def stream_values(spark, d):
    v = T.ticks(spark, d).select("symbol", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("study"), F.lit("k").alias("title"), F.col("size").alias("value"), F.col("id").alias("seq"), (F.col("id") % 4 != 0).alias("visible"))
    return X.stream_values_batch(v).drop("visible")


@query(
    "st6_stream_panes",
    f"""WITH {bars_sql('240', key='user_id::VARCHAR')}, e AS (SELECT substr(symbol, 1, 2) AS layout, ts, count(*) AS n_panes,
  list((symbol, open, high, low, close, volume) ORDER BY symbol) AS panes FROM bars GROUP BY 1, 2),
l AS (SELECT *, lag(panes) OVER (PARTITION BY layout ORDER BY ts) AS b FROM e)
SELECT layout, ts, n_panes, list_sum(list_transform(panes, lambda p: p[6])) AS volume FROM l WHERE b IS NULL OR b <> panes""",
)
def stream_panes(spark, d):
    """A layout for each two first digits of a user's number."""
    bars = B.build_bars(T.ticks(spark, d, "user_id"), "240")
    panes = bars.select("symbol", "resolution").distinct().select(F.substring("symbol", 1, 2).alias("layout"), F.col("symbol").alias("pane_index"), "symbol", "resolution")
    volume = F.aggregate("panes", F.lit(0.0), lambda total, p: total + p["volume"])
    return X.stream_panes_batch(panes, bars).select("layout", "ts", "n_panes", volume.alias("volume"))


HOLDING = f"""CASE WHEN coalesce(last_value(CASE WHEN signal <> 'flat' THEN signal END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 'sell') = 'buy' THEN 'base' ELSE 'quote' END"""


@query("st8_stream_signals", f"{BARS}, {SCALPER} SELECT symbol, ts, close, signal, {HOLDING} AS holding FROM sig")
def stream_signals(spark, d):
    return X.stream_signals_batch(hourly(spark, d))


@query("st7_streaming_bars", f"WITH {bars_sql('30')} SELECT {COLUMNS} FROM bars")
def streaming_bars(spark, d):
    """The stream's plan on a table, where nothing is late."""
    t = T.ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return X.streaming_bars(t, 30).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


FORMING = "(PARTITION BY symbol, time_bucket(INTERVAL '60 minutes', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query(
    "st3_stream_bars_forming",
    f"""WITH {bars_sql('15')}, f AS (SELECT symbol, '60' AS resolution, ts AS part_ts, time_bucket(INTERVAL '60 minutes', ts) AS ts, first_value(open) OVER {FORMING} AS open, max(high) OVER {FORMING} AS high,
  min(low) OVER {FORMING} AS low, close, sum(volume) OVER {FORMING} AS volume FROM bars),
l AS (SELECT *, lag((ts, open, high, low, close, volume)) OVER (PARTITION BY symbol ORDER BY part_ts) AS b, lag(ts) OVER (PARTITION BY symbol ORDER BY part_ts) AS bt FROM f),
k AS (SELECT * FROM l WHERE b IS NULL OR b IS DISTINCT FROM (ts, open, high, low, close, volume))
SELECT {COLUMNS}, part_ts, bt IS NULL OR bt <> ts AS new_bar FROM k""",
)
def stream_bars_forming(spark, d):
    """The hour's bar as each of its quarters leaves it."""
    return X.stream_bars_batch(X.forming_bars(B.build_bars(T.ticks(spark, d), "15"), "60"), "part_ts")


@query(
    "st9_sliding_stats",
    f"""WITH {TICKS.format(key='event_type')}, w AS (SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes' * k AS ts, price, size FROM ticks, (SELECT unnest(range(6)) AS k)),
v AS (SELECT symbol, ts, count(*) AS n_ticks, sum(price * size) / nullif(sum(size), 0) AS vwap FROM w GROUP BY 1, 2) SELECT symbol, ts, n_ticks, {r6('vwap')} FROM v""",
)
def sliding_stats(spark, d):
    return rounded(X.sliding_stats(T.ticks(spark, d)), "vwap")


@query(
    "st9_session_bars",
    f"""WITH {TICKS.format(key='event_type')}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM ticks),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT symbol, min(ts) AS ts, max(ts) + INTERVAL '30 minutes' AS session_end, first(price ORDER BY ts, id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, id) AS close, sum(size) AS volume FROM s GROUP BY symbol, n""",
)
def session_bars(spark, d):
    return X.session_bars(T.ticks(spark, d))
