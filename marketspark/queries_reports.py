"""Queries of strategy reports, drawings, order books, studies, catalogs and scripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import catalog as C
from .operators import depth as D
from .operators import drawings as R
from .operators import lint as L
from .operators import strategy as Y
from .operators import studies as V
from .queries import query
from .sources import tables as T


def r6(name: str) -> str:
    return f"floor({name} * 1000000.0 + 0.5) / 1000000.0 AS {name}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: S.js_round(F.col(n), 6) for n in names})


KEY = "printf('%012d.%03d.%012d', l_orderkey, l_linenumber, l_partkey)"
TRADES = f"""WITH trades AS (SELECT l_suppkey::VARCHAR AS strategy, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side,
  l_shipdate - INTERVAL 1 DAY * l_linenumber AS entry_ts, l_shipdate AS exit_ts, l_quantity AS qty,
  CAST(floor(l_extendedprice * (l_tax - l_discount) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS pnl, {KEY} AS trade_id FROM lineitem)"""
RATIOS = ("return_pct", "win_rate", "profit_factor", "avg_trade", "avg_win", "avg_loss", "reward_risk", "sharpe")
METRICS = """count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum(pnl)::DOUBLE AS net_profit,
  sum(pnl)::DOUBLE / 10000 * 100 AS return_pct, count(*) FILTER (pnl > 0) / count(*) AS win_rate,
  sum(pnl) FILTER (pnl > 0)::DOUBLE / nullif(-(sum(pnl) FILTER (pnl < 0)::DOUBLE), 0) AS profit_factor, sum(pnl)::DOUBLE / count(*) AS avg_trade,
  sum(pnl) FILTER (pnl > 0)::DOUBLE / nullif(count(*) FILTER (pnl > 0), 0) AS avg_win, sum(pnl) FILTER (pnl < 0)::DOUBLE / nullif(count(*) FILTER (pnl < 0), 0) AS avg_loss,
  (sum(pnl) FILTER (pnl > 0)::DOUBLE / nullif(count(*) FILTER (pnl > 0), 0)) / nullif(-(sum(pnl) FILTER (pnl < 0)::DOUBLE) / nullif(count(*) FILTER (pnl < 0), 0), 0) AS reward_risk,
  max(pnl) FILTER (pnl > 0)::DOUBLE AS largest_win, min(pnl) FILTER (pnl < 0)::DOUBLE AS largest_loss,
  CASE WHEN count(*) >= 2 AND stddev_samp(pnl::DOUBLE) > 0 THEN sum(pnl)::DOUBLE / count(*) / stddev_samp(pnl::DOUBLE) END AS sharpe"""
OUT = f"total_trades, wins, losses, net_profit, {', '.join(map(r6, RATIOS))}, largest_win, largest_loss"
O = "PARTITION BY strategy ORDER BY exit_ts, trade_id"  # noqa: E741
UPTO = f"({O} ROWS UNBOUNDED PRECEDING)"
CURVE = f"""e AS (SELECT *, (sum(pnl) OVER {UPTO} + 10000)::DOUBLE AS equity FROM trades),
p AS (SELECT *, greatest(10000.0::DOUBLE, max(equity) OVER {UPTO}) AS peak FROM e), curve AS (SELECT *, equity - peak AS drawdown, (equity - peak) / peak * 100 AS drawdown_pct FROM p)"""
DRAWN = f"""runs AS (SELECT *, row_number() OVER ({O}) - sum((drawdown < 0)::INT) OVER {UPTO} AS run FROM curve),
under AS (SELECT strategy, run, count(*) FILTER (drawdown < 0) AS n, min(drawdown) AS d, min(drawdown_pct) AS q FROM runs GROUP BY 1, 2),
drawn AS (SELECT strategy, min(d) AS max_drawdown, min(q) AS max_drawdown_pct, max(n) AS longest_drawdown FROM under GROUP BY 1)"""
LOST = f"""lr AS (SELECT *, (pnl < 0)::INT AS l, row_number() OVER ({O}) - sum((pnl < 0)::INT) OVER {UPTO} AS run FROM trades),
ln AS (SELECT strategy, run, sum(l) AS n FROM lr GROUP BY 1, 2), lost AS (SELECT strategy, max(n)::BIGINT AS max_consecutive_losses FROM ln GROUP BY 1)"""
MARKET = """sp AS (SELECT strategy, epoch(entry_ts)::BIGINT AS a, epoch(exit_ts)::BIGINT AS b, trade_id FROM trades),
re AS (SELECT *, max(b) OVER (PARTITION BY strategy ORDER BY a, b, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM sp),
market AS (SELECT strategy, sum(greatest(0, b - greatest(a, coalesce(reached, a))))::DOUBLE / nullif(max(b) - min(a), 0) AS time_in_market FROM re GROUP BY 1)"""


@query("agg10_strategy_metrics", f"{TRADES}, m AS (SELECT strategy, {METRICS} FROM trades GROUP BY 1) SELECT strategy, {OUT} FROM m")
def strategy_metrics(spark, d):
    return rounded(Y.strategy_metrics(T.trades(spark, d)), *RATIOS)


@query("agg11_long_short", f"{TRADES}, m AS (SELECT strategy, coalesce(side, 'all') AS side, {METRICS} FROM trades GROUP BY GROUPING SETS ((strategy, side), (strategy))) SELECT strategy, side, {OUT} FROM m")
def long_short(spark, d):
    return rounded(Y.long_short_breakdown(T.trades(spark, d)), *RATIOS)


@query("agg12_time_in_market", f"{TRADES}, {MARKET} SELECT strategy, {r6('time_in_market')} FROM market")
def time_in_market(spark, d):
    return rounded(Y.time_in_market(T.trades(spark, d)), "time_in_market")


@query("agg13_max_consecutive_losses", f"{TRADES}, {LOST} SELECT * FROM lost")
def max_consecutive_losses(spark, d):
    return Y.max_consecutive_losses(T.trades(spark, d))


@query("win1_equity_curve", f"{TRADES}, {CURVE} SELECT strategy, trade_id, exit_ts, equity, drawdown, {r6('drawdown_pct')} FROM curve")
def equity_curve(spark, d):
    return rounded(Y.equity_curve(T.trades(spark, d)).select("strategy", "trade_id", "exit_ts", "equity", "drawdown", "drawdown_pct"), "drawdown_pct")


@query("win2_drawdown", f"{TRADES}, {CURVE}, {DRAWN} SELECT strategy, max_drawdown, {r6('max_drawdown_pct')}, longest_drawdown FROM drawn")
def drawdown(spark, d):
    return rounded(Y.drawdown_summary(Y.equity_curve(T.trades(spark, d))), "max_drawdown_pct")


@query(
    "wf4_strategy_report",
    f"""{TRADES}, {CURVE}, {DRAWN}, {LOST}, {MARKET}, m AS (SELECT strategy, {METRICS} FROM trades GROUP BY 1),
r AS (SELECT m.*, max_drawdown, max_drawdown_pct, longest_drawdown, max_consecutive_losses, time_in_market FROM m JOIN drawn USING (strategy) JOIN lost USING (strategy) JOIN market USING (strategy))
SELECT strategy, {OUT}, max_drawdown, {r6('max_drawdown_pct')}, longest_drawdown, max_consecutive_losses, {r6('time_in_market')},
  concat_ws(',', CASE WHEN win_rate < 0.5 AND profit_factor > 1 THEN 'tighter_entries' END, CASE WHEN max_drawdown_pct < -20 THEN 'position_sizing' END,
    CASE WHEN profit_factor < 1.2 THEN 'fundamental' END, CASE WHEN total_trades < 30 THEN 'few_trades' END) AS flags FROM r""",
)
def strategy_report(spark, d):
    out = Y.strategy_report(T.trades(spark, d)).withColumn("flags", F.array_join("flags", ","))
    return rounded(out, *RATIOS, "max_drawdown_pct", "time_in_market")


@query("win3_loss_streak_stop", f"""{TRADES}, s AS (SELECT *, sum((pnl < 0)::INT) OVER (PARTITION BY strategy, exit_ts::DATE ORDER BY exit_ts, trade_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS hit FROM trades)
SELECT strategy, trade_id, exit_ts, pnl::DOUBLE AS pnl, coalesce(bool_or(hit) OVER (PARTITION BY strategy, exit_ts::DATE ORDER BY exit_ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM s""")
def loss_streak_stop(spark, d):
    return Y.loss_streak_stop(T.trades(spark, d)).select("strategy", "trade_id", "exit_ts", F.col("pnl").cast("double").alias("pnl"), "blocked")


@query("win4_open_positions", f"""{TRADES}, s AS (SELECT strategy, entry_ts AS ts, 1 AS d FROM trades UNION ALL SELECT strategy, exit_ts, -1 FROM trades), e AS (SELECT strategy, ts, sum(d) AS d FROM s GROUP BY 1, 2),
n AS (SELECT strategy, ts, (sum(d) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING))::BIGINT AS n_open FROM e) SELECT *, n_open > 2 AS breach FROM n""")
def open_positions(spark, d):
    return Y.open_positions(T.trades(spark, d))


@query("win5_trade_rate_limit", f"""{TRADES}, t AS (SELECT *, epoch(entry_ts)::BIGINT AS s FROM trades), n AS (SELECT strategy, trade_id, entry_ts, count(*) OVER (PARTITION BY strategy ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS recent FROM t) SELECT *, recent > 6 AS over_limit FROM n""")
def trade_rate_limit(spark, d):
    return Y.trade_rate_limit(T.trades(spark, d)).select("strategy", "trade_id", "entry_ts", "recent", "over_limit")


@query("win6_session_open_block", "SELECT event_id, hour(ts) * 60 + minute(ts) - 870 BETWEEN 0 AND 14 AS blocked FROM events")
def session_open_block(spark, d):
    t = T.table(spark, d, "events").select("event_id", F.col("ts").alias("entry_ts"))
    return Y.session_open_block(t, "14:30", 15).select("event_id", "blocked")


@query("top2_first_trades", f"{TRADES}, n AS (SELECT strategy, trade_id, exit_ts, row_number() OVER ({O})::INTEGER AS trade_no FROM trades) SELECT * FROM n WHERE trade_no <= 20")
def first_trades(spark, d):
    return Y.first_trades(T.trades(spark, d)).select("strategy", "trade_id", "exit_ts", "trade_no")


@query("top1_rank_scan", f"{TRADES}, m AS (SELECT strategy, side, sum(pnl)::DOUBLE AS net_profit FROM trades GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY side ORDER BY net_profit DESC NULLS LAST)::INTEGER AS rank FROM m) SELECT * FROM k WHERE rank <= 10")
def rank_scan(spark, d):
    m = Y.strategy_metrics(T.trades(spark, d), ("strategy", "side")).select("strategy", "side", "net_profit")
    return Y.rank_scan(m, "net_profit", ("side",), 10)


@query("agg17_practice_report", f"{TRADES} SELECT strategy, side, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum(pnl)::DOUBLE AS net_pnl FROM trades GROUP BY 1, 2")
def practice_report(spark, d):
    return Y.practice_report(T.trades(spark, d), ("strategy", "side"))


@query("agg15_order_stats", "SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS skip_reason, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS placed FROM orders GROUP BY 1")
def order_stats(spark, d):
    o = T.table(spark, d, "orders")
    return Y.order_stats(o.select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("skip_reason"), (F.col("o_orderstatus") == "F").alias("order_placed")))


# Drawings

LINES = f"""WITH lines AS (SELECT 'Study ' || l_suppkey AS study, {KEY} AS id, l_quantity + l_tax / 1000 AS y1, CASE WHEN l_returnflag = 'A' THEN l_quantity + l_tax / 1000 ELSE l_linenumber::DOUBLE END AS y2 FROM lineitem)"""
TEXT = "CAST(CAST({x} AS DECIMAL(18,4)) AS VARCHAR)"


def _text(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("decimal(18,4)").cast("string")), " ")


@query("agg5_horizontal_levels", f"""{LINES}, d AS (SELECT study, count(*) AS total_lines, list_reverse_sort(list(DISTINCT floor(y1 * 100 + 0.5) / 100) FILTER (y1 = y2)) AS levels FROM lines GROUP BY 1)
SELECT study, total_lines, array_to_string(list_transform(coalesce(levels, []), lambda x: {TEXT.format(x='x')}), ' ') AS levels FROM d""")
def horizontal_levels(spark, d):
    return R.horizontal_levels(T.drawn_lines(spark, d)).withColumn("levels", _text("levels"))


@query("agg6_stream_levels", f"""{LINES}, d AS (SELECT study, list_reverse_sort(list(DISTINCT CASE WHEN y1 = y2 THEN y1 ELSE coalesce(nullif(y1, 0), y2) END)) AS levels FROM lines WHERE lower(study) LIKE '%study 1%' GROUP BY 1)
SELECT study, array_to_string(list_transform(levels, lambda x: {TEXT.format(x='x')}), ' ') AS levels FROM d""")
def stream_levels(spark, d):
    return R.stream_levels(R.study_filter(T.drawn_lines(spark, d), "STUDY 1", case_sensitive=False)).withColumn("levels", _text("levels"))


@query("agg7_price_zones", f"""{LINES}, z AS (SELECT DISTINCT study, floor(greatest(y1, y2) * 100 + 0.5) / 100 AS high, floor(least(y1, y2) * 100 + 0.5) / 100 AS low FROM lines),
t AS (SELECT study, count(*) AS total_boxes FROM lines GROUP BY 1), l AS (SELECT study, count(*) AS n_zones, first(high ORDER BY high DESC, low DESC) AS top_high, first(low ORDER BY high DESC, low DESC) AS top_low FROM z GROUP BY 1)
SELECT study, total_boxes, n_zones::INTEGER AS n_zones, top_high, top_low FROM t JOIN l USING (study)""")
def price_zones(spark, d):
    z = R.price_zones(T.drawn_lines(spark, d))
    return z.select("study", "total_boxes", F.size("zones").alias("n_zones"), F.get("zones", 0)["high"].alias("top_high"), F.get("zones", 0)["low"].alias("top_low"))


LABELS = """WITH labels AS (SELECT 'Study ' || conv_id AS study, turn AS seq, CASE WHEN role = 'user' THEN text ELSE '' END AS text, CASE WHEN turn % 3 <> 1 THEN length(text) / 7 END AS price FROM conversations)"""


@query("agg8_latest_labels", f"""{LABELS}, s AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY study) AS total_labels FROM labels WHERE text <> '' OR price IS NOT NULL)
SELECT study, seq, text, floor(price * 100 + 0.5) / 100 AS price, total_labels FROM s WHERE r <= 2""")
def latest_labels(spark, d):
    return R.latest_labels(T.labels(spark, d), 2)


@query("agg8_stream_labels", f"{LABELS}, s AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY seq) AS r FROM labels WHERE text <> '') SELECT study, seq, text, price FROM s WHERE r <= 50")
def stream_labels(spark, d):
    return R.stream_labels(T.labels(spark, d))


CELLS = """WITH cells AS (SELECT (l_suppkey % 10)::VARCHAR AS study, coalesce(CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END, 0) AS tid, l_linenumber AS row, (l_partkey % 4)::INTEGER AS col,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || l_linestatus END AS text, printf('%012d.%012d.%012d', l_orderkey, l_partkey, l_suppkey) AS seq FROM lineitem),
w AS (SELECT study, tid, row, col, last(text ORDER BY seq) AS text FROM cells GROUP BY 1, 2, 3, 4)"""


@query("agg9_table_rows", f"{CELLS} SELECT study, tid, row, string_agg(text, ' | ' ORDER BY col) AS line FROM w WHERE text <> '' GROUP BY 1, 2, 3")
def table_rows(spark, d):
    return R.table_rows(T.cells(spark, d))


@query("st5_stream_tables", f"{CELLS} SELECT study, tid, row, string_agg(text, '~' ORDER BY col) AS texts FROM w GROUP BY 1, 2, 3")
def stream_tables(spark, d):
    from .streaming.feeds import drawing_feed

    return drawing_feed(T.cells(spark, d), "tables").withColumn("texts", F.array_join("texts", "~"))


@query("set2_remove_entity", f"{LINES} SELECT bool_or(id = '000000000001.001.000000000001') AS removed, count(*) FILTER (id <> '000000000001.001.000000000001') AS remaining_count FROM lines")
def remove_entity(spark, d):
    return R.remove_entity(T.drawn_lines(spark, d), "000000000001.001.000000000001")


REMOVALS = "removals AS (SELECT study, id FROM lines WHERE y1 = y2 UNION ALL SELECT study, 'none' FROM lines WHERE y1 > y2)"


def _removals(lines: DataFrame) -> DataFrame:
    """All level lines, and an id that isn't there for each falling one."""
    return lines.where("y1 = y2").select("study", "id").unionByName(lines.where("y1 > y2").select("study", F.lit("none").alias("id")))


@query("set2_remaining_drawings", f"{LINES}, {REMOVALS} SELECT study, id, y1, y2 FROM lines l WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE r.study = l.study AND r.id = l.id)")
def remaining_drawings(spark, d):
    lines = T.drawn_lines(spark, d)
    return R.remaining_drawings(lines, _removals(lines)).select("study", "id", "y1", "y2")


@query(
    "set2_removal_outcomes",
    f"""{LINES}, {REMOVALS}, d AS (SELECT DISTINCT study, id FROM removals), o AS (SELECT study, count(*) AS asked, count(*) FILTER (id <> 'none') AS removed, count(*) FILTER (id = 'none') AS not_found FROM d GROUP BY 1)
SELECT o.*, (SELECT count(*) FROM lines l WHERE l.study = o.study AND l.y1 IS DISTINCT FROM l.y2) AS remaining_count FROM o""",
)
def removal_outcomes(spark, d):
    lines = T.drawn_lines(spark, d)
    return R.removal_outcomes(lines, _removals(lines))


@query("flt1_study_filter", f"{LINES} SELECT study, count(*) AS n FROM lines WHERE study LIKE '%dy 2%' GROUP BY 1")
def study_filter(spark, d):
    return R.study_filter(T.drawn_lines(spark, d), "dy 2").groupBy("study").agg(F.count(F.lit(1)).alias("n"))


# Order books

DEPTH = f"""WITH rows AS (SELECT l_suppkey::VARCHAR AS symbol, {KEY} AS row_index, CASE l_returnflag WHEN 'A' THEN 'row ask-level' WHEN 'R' THEN 'row BUY' ELSE 'row' END AS class_text,
  CASE WHEN l_linenumber <> 7 THEN floor(l_quantity) + 0.25::DOUBLE END AS price, CASE WHEN l_linenumber <> 3 THEN l_partkey::DOUBLE ELSE 0.0 END AS size FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_index) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM rows),
levels AS (SELECT symbol, row_index, CASE WHEN class_text = 'row BUY' THEN 'bid' WHEN class_text = 'row ask-level' THEN 'ask' WHEN i < c / 2 THEN 'ask' ELSE 'bid' END AS side, price, size FROM n WHERE price IS NOT NULL)"""


@query("agg4_classify_depth", f"{DEPTH} SELECT symbol, side, count(*) AS levels, sum(price) AS prices, sum(size) AS sizes FROM levels GROUP BY 1, 2")
def classify_depth(spark, d):
    return D.classify_depth(T.depth_rows(spark, d)).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("levels"), F.sum("price").alias("prices"), F.sum("size").alias("sizes"))


@query("agg3_depth_summary", f"""{DEPTH}, s AS (SELECT symbol, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels FROM levels GROUP BY 1)
SELECT *, floor((best_ask - best_bid) * 1000000 + 0.5) / 1000000 AS spread FROM s""")
def depth_summary(spark, d):
    return D.depth_summary(D.classify_depth(T.depth_rows(spark, d)))


# Studies

VALUES = f"""WITH v AS (SELECT (l_suppkey % 50)::VARCHAR AS symbol, l_returnflag AS study, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 't' || l_linenumber END AS title,
  CASE WHEN l_linenumber % 3 = 0 THEN '∅' ELSE floor(l_quantity)::INTEGER::VARCHAR END AS value, {KEY} || l_suppkey AS seq FROM lineitem), c AS (SELECT * FROM v WHERE title <> '' AND value <> '∅')"""


def _values(spark, d) -> DataFrame:
    line = T.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return line.select(
        (F.col("l_suppkey") % 50).cast("string").alias("symbol"),
        F.col("l_returnflag").alias("study"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("title"),
        F.when(n % 3 == 0, "∅").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"),
        F.concat(F.format_string("%012d.%03d.%012d", "l_orderkey", "l_linenumber", "l_partkey"), F.col("l_suppkey").cast("string")).alias("seq"),
    )


@query("agg2_study_map", f"""{VALUES}, l AS (SELECT symbol, study, title, last(value ORDER BY seq) AS value FROM c GROUP BY 1, 2, 3), m AS (SELECT symbol, study, string_agg(title || '=' || value, ' ' ORDER BY title) AS "values" FROM l GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY symbol) AS study_count FROM m""")
def study_map(spark, d):
    out = V.study_map(V.clean_study_values(_values(spark, d)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return out.withColumn("values", text)


@query("flt3_clean_values", f"{VALUES} SELECT symbol, study, count(*) AS n FROM c GROUP BY 1, 2")
def clean_values(spark, d):
    return V.clean_study_values(_values(spark, d)).groupBy("symbol", "study").agg(F.count(F.lit(1)).alias("n"))


@query("flt2_flt4_numeric_values", "SELECT event_id, value FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND value IS NOT NULL")
def visible_numeric(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), (F.col("event_id") % 3 != 0).alias("visible"))
    return V.numeric_values(V.visible_only(e)).select("event_id", "value")


@query("flt5_trim_inputs", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN length(text) <= 200 ELSE length(text) <= 500 END AS kept FROM conversations")
def trim_inputs(spark, d):
    c = T.table(spark, d, "conversations")
    inputs = F.array(F.struct(F.when(F.col("turn") % 2 == 0, "text").otherwise("length").alias("id"), F.col("text").alias("value")))
    return c.select("conv_id", "turn", (F.size(V.trim_inputs(inputs)) == 1).alias("kept"))


@query("flt6_override_inputs", "SELECT p_partkey, 'length=' || CASE WHEN p_size % 2 = 0 THEN '50' ELSE p_size::VARCHAR END || ' src=' || p_brand AS inputs, CASE WHEN p_size % 2 = 0 THEN 'length' ELSE '' END AS updated FROM part")
def override_inputs(spark, d):
    p = T.table(spark, d, "part")
    entry = lambda k, v: F.struct(F.lit(k).alias("id"), v.alias("value"))
    even = F.col("p_size") % 2 == 0
    some = p.select("p_partkey", F.array(entry("length", F.col("p_size").cast("string")), entry("src", F.col("p_brand"))).alias("inputs"), even.alias("even"))
    done = V.override_inputs(some.where("even"), {"length": "50", "nope": "1"}).unionByName(some.where(~F.col("even")).withColumn("updated", F.array().cast("array<string>")))
    text = F.array_join(F.transform("inputs", lambda i: F.concat(i["id"], F.lit("="), i["value"])), " ")
    return done.select("p_partkey", text.alias("inputs"), F.array_join("updated", ",").alias("updated"))


@query("flt9_flt10_records", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 2 END::INTEGER AS scalars, 'Max Drawdown,net_profit' AS equity_keys FROM orders")
def records(spark, d):
    o = T.table(spark, d, "orders")
    record = F.create_map(F.lit("net_profit"), F.col("o_totalprice").cast("string"), F.lit("status"), F.when(F.col("o_orderstatus") == "F", F.lit("F")), F.lit("Max Drawdown"), F.lit("1"))
    return o.select("o_orderkey", F.size(V.scalar_fields(record)).alias("scalars"), F.array_join(F.array_sort(F.map_keys(V.equity_summary(record))), ",").alias("equity_keys"))


EQUITY_KEYS = ["Net Profit", "max drawdown %", "total_trades", "EQUITY", "gross_loss", "profitFactor", "internet", "win_rate"]


@query(
    "flt10_equity_by_key",
    f"""WITH r AS (SELECT o_orderkey, {EQUITY_KEYS}[(o_orderkey % 8)::INTEGER + 1] AS k1, 'customer ' || o_custkey AS k2, o_orderpriority AS k3, o_totalprice, o_orderstatus FROM orders),
e AS (SELECT o_orderkey, k1 AS k, o_totalprice::VARCHAR AS v FROM r UNION ALL SELECT o_orderkey, k2, CASE WHEN o_orderstatus = 'F' THEN 'x' END FROM r UNION ALL SELECT o_orderkey, k3 || ' net', o_orderstatus FROM r WHERE o_orderstatus <> 'O')
SELECT o_orderkey, coalesce(string_agg(k, ',' ORDER BY k) FILTER (regexp_matches(lower(k), 'equity|drawdown|profit|net')), '') AS equity_keys, count(v) AS scalars FROM e GROUP BY 1""",
)
def equity_by_key(spark, d):
    """Records whose keys differ from order to order."""
    o = T.table(spark, d, "orders")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    fixed = F.array(*map(F.lit, EQUITY_KEYS))
    some = F.array(entry(F.get(fixed, (F.col("o_orderkey") % 8).cast("int")), F.col("o_totalprice").cast("string")), entry(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), F.when(F.col("o_orderstatus") == "F", "x")))
    last = F.filter(F.array(entry(F.concat("o_orderpriority", F.lit(" net")), F.col("o_orderstatus"))), lambda _: F.col("o_orderstatus") != "O")
    record = F.map_from_entries(F.concat(some, last))
    return o.select("o_orderkey", F.array_join(F.array_sort(F.map_keys(V.equity_summary(record))), ",").alias("equity_keys"), F.size(V.scalar_fields(record)).cast("long").alias("scalars"))


@query("flt11_is_ticker", r"SELECT p_partkey, regexp_matches(p_name, '^[A-Z][A-Z0-9.:!]{0,20}$') AS name_is, regexp_matches(upper(left(p_type, 4)) || p_size, '^[A-Z][A-Z0-9.:!]{0,20}$') AS code_is FROM part")
def is_ticker(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", S.is_ticker(F.col("p_name")).alias("name_is"), S.is_ticker(F.concat(F.upper(F.substring("p_type", 1, 4)), F.col("p_size").cast("string"))).alias("code_is"))


# Catalog

CATALOG = """WITH c AS (SELECT 'P' || p_partkey AS symbol, p_name AS description, replace(p_brand, '#', '') AS prefix, CASE WHEN p_partkey % 3 <> 0 THEN replace(p_brand, '#', '') END AS ex, p_type AS type, p_partkey AS seq FROM part)"""


@query("top4_search_symbols", f"""{CATALOG}, q AS (SELECT 'p1' || r_regionkey AS query FROM region UNION ALL SELECT 'P7'), h AS (SELECT query, symbol, description, coalesce(ex, prefix) AS exchange, type,
  CASE WHEN ex IS NOT NULL THEN ex || ':' || symbol ELSE symbol END AS full_name, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN lower(symbol) = lower(query) THEN 0 WHEN starts_with(lower(symbol), lower(query)) THEN 1
  WHEN contains(lower(symbol), lower(query)) THEN 2 ELSE 3 END, seq) AS rank FROM c JOIN q ON contains(lower(symbol), lower(query)) OR contains(lower(description), lower(query)))
SELECT query, symbol, description, exchange, type, full_name, rank::INTEGER AS rank FROM h WHERE rank <= 15""")
def search_symbols(spark, d):
    asked = T.table(spark, d, "region").select(F.concat(F.lit("p1"), F.col("r_regionkey").cast("string")).alias("query"))
    asked = asked.unionByName(T.table(spark, d, "region").where("r_regionkey = 0").select(F.lit("P7").alias("query")))
    return C.search_symbols(T.catalog(spark, d), asked)


@query("top5_resolve_name", """WITH n AS (SELECT n_nationkey AS id, n_name AS name, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT lower(substr(r_name, 1, 3)) AS target FROM region UNION ALL SELECT lower(n_name) FROM nation),
m AS (SELECT target, first(id ORDER BY CASE WHEN lower(name) = lower(target) OR lower(title) = lower(target) THEN 0 ELSE 1 END, id) AS id FROM t JOIN n ON contains(lower(name), lower(target)) OR contains(lower(title), lower(target)) GROUP BY 1)
SELECT t.target, m.id, n.name FROM t LEFT JOIN m ON t.target = m.target LEFT JOIN n ON m.id = n.id""")
def resolve_name(spark, d):
    n = T.table(spark, d, "nation").join(T.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("title"), F.col("n_nationkey").alias("seq"))
    targets = T.table(spark, d, "region").select(F.lower(F.substring("r_name", 1, 3)).alias("target")).unionByName(T.table(spark, d, "nation").select(F.lower("n_name").alias("target")))
    return C.resolve_name(names, targets)


@query("top3_dedupe_keep_first", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE n = 1")
def dedupe_keep_first(spark, d):
    return C.dedupe_keep_first(T.table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("top6_list_scripts", "SELECT p_partkey::VARCHAR AS id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'Untitled' END AS name, CASE WHEN p_size % 3 = 1 THEN p_brand END AS title, nullif(p_size % 4, 0) AS version, nullif(p_partkey % 2, 0) AS modified FROM part")
def list_scripts(spark, d):
    p = T.table(spark, d, "part")
    k = F.col("p_size") % 3
    return C.list_scripts(p.select(F.col("p_partkey").cast("string").alias("id"), F.when(k == 0, F.col("p_name")).otherwise("").alias("script_name"), F.when(k == 1, F.col("p_brand")).alias("script_title"), (F.col("p_size") % 4).alias("version"), (F.col("p_partkey") % 2).alias("modified")))


# Scripts

SCRIPTS = r"""WITH s AS (SELECT p_partkey AS script_id, p_size AS z,
  CASE WHEN p_size % 5 = 0 THEN '//@version=4' || chr(10) WHEN p_size % 5 = 1 THEN '' ELSE '//@version=6' || chr(10) END ||
  CASE WHEN p_size % 3 = 0 THEN 'strategy("s")' ELSE 'indicator("s")' END || chr(10) ||
  CASE p_size % 4 WHEN 0 THEN 'a = array.from()' WHEN 1 THEN 'a = array.new_float(3)' WHEN 2 THEN 'a = array.new<int>(n)' ELSE 'a = array.from(1, 2, 3, 4)' END || chr(10) ||
  'x = array.get(a, ' || p_size || ') + array.get(a, -1)' || chr(10) || '  y = a.first() + a.last()' || chr(10) ||
  CASE WHEN p_size % 2 = 0 THEN 'strategy.entry("L", strategy.long)' || chr(10) || 'strategy.close("L")' ELSE 'plot(x)' END AS source FROM part)"""


@query("agg18_text_stats", f"{SCRIPTS} SELECT script_id, len(string_split(source, chr(10)))::INTEGER AS line_count, length(source)::INTEGER AS char_count FROM s")
def text_stats(spark, d):
    return C.text_stats(T.scripts(spark, d))


@query(
    "wf6_script_lint",
    SCRIPTS
    + rf""", l AS (SELECT script_id, unnest(string_split(source, chr(10))) AS text, generate_subscripts(string_split(source, chr(10)), 1) AS line FROM s),
d AS (SELECT script_id, line, CASE WHEN regexp_matches(text, '{L.DECLARED_FROM}') THEN regexp_extract(text, '{L.DECLARED_FROM}', 1) ELSE regexp_extract(text, '{L.DECLARED_NEW}', 1) END AS name,
  CASE WHEN NOT regexp_matches(text, '{L.DECLARED_FROM}') THEN TRY_CAST(regexp_extract(text, '{L.DECLARED_NEW}', 2) AS INTEGER) WHEN trim(regexp_extract(text, '{L.DECLARED_FROM}', 2)) = '' THEN 0
  ELSE len(string_split(regexp_extract(text, '{L.DECLARED_FROM}', 2), ',')) END AS size FROM l WHERE regexp_matches(text, '{L.DECLARED_FROM}') OR regexp_matches(text, '{L.DECLARED_NEW}')),
arrays AS (SELECT script_id, name, last(size ORDER BY line) AS size FROM d GROUP BY 1, 2),
p AS (SELECT script_id, line, kind, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS parts FROM l, (VALUES ('access', '{L.ACCESS}'), ('ends', '{L.ENDS}')) AS v(kind, pattern)),
e AS (SELECT script_id, line, kind, parts, found, unnest(found) AS m, generate_subscripts(found, 1) AS k FROM p),
g AS (SELECT script_id, line, kind, len(array_to_string(parts[1:k], '')) + len(array_to_string(found[1:k - 1], '')) + 1 AS "column", m, CASE kind WHEN 'access' THEN regexp_extract(m, '{L.ACCESS}', 2) ELSE regexp_extract(m, '{L.ENDS}', 1) END AS name FROM e),
h AS (SELECT g.*, size, regexp_extract(m, '{L.ACCESS}', 1) AS method, regexp_extract(m, '{L.ENDS}', 2) AS at_end, TRY_CAST(regexp_extract(m, '{L.ACCESS}', 3) AS BIGINT) AS i FROM g JOIN arrays USING (script_id, name)),
bounds AS (SELECT script_id, line, "column", printf('{L.BEYOND_SIZE}', method, name, i::VARCHAR, i::VARCHAR, size::VARCHAR) AS message, 'error' AS severity FROM h WHERE kind = 'access' AND size IS NOT NULL AND (i < 0 OR i >= size)),
ends AS (SELECT script_id, line, "column", printf('{L.MAYBE_EMPTY}', name, at_end) AS message, 'warning' AS severity FROM h WHERE kind = 'ends' AND name <> 'array' AND size = 0),
orders AS (SELECT script_id, min(line) FILTER (contains(text, 'strategy.entry') OR contains(text, 'strategy.close')) AS line, 1 AS "column", '{L.NO_STRATEGY}' AS message, 'error' AS severity FROM l GROUP BY 1 HAVING NOT bool_or(starts_with(trim(text), 'strategy('))),
f AS (SELECT script_id, first(trim(text) ORDER BY line) AS stop FROM l WHERE starts_with(trim(text), '//@version=') OR (trim(text) <> '' AND NOT starts_with(trim(text), '//')) GROUP BY 1),
old AS (SELECT script_id, 1 AS line, 1 AS "column", printf('{L.OLD_VERSION}', regexp_extract(source, '{L.VERSION}', 1)) AS message, 'info' AS severity FROM s LEFT JOIN f USING (script_id) WHERE TRY_CAST(regexp_extract(source, '{L.VERSION}', 1) AS INTEGER) < 5 AND NOT coalesce(starts_with(stop, '//@version=6'), false))
SELECT script_id, line::INTEGER AS line, "column"::INTEGER AS "column", message, severity FROM (SELECT * FROM bounds UNION ALL SELECT * FROM ends UNION ALL SELECT * FROM orders WHERE line IS NOT NULL UNION ALL SELECT * FROM old)""",
)
def script_lint(spark, d):
    return L.script_lint(T.scripts(spark, d))


@query(
    "sf11_compile_report",
    """SELECT o_orderkey AS script_id, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS error_count, (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS warning_count,
  o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 AS compiled FROM orders""",
)
def compile_report(spark, d):
    o = T.table(spark, d, "orders")
    entry = '[{"start":{"line":3,"column":2},"end":{"line":3,"column":9},"message":"bad"}]'
    report = F.concat(F.lit('{"result":{"errors2":'), F.when(F.col("o_orderstatus") == "F", entry).otherwise("[]"), F.lit(',"warnings2":'), F.when(F.col("o_orderstatus") == "O", entry).otherwise("[]"), F.lit("}"), F.when(F.col("o_orderkey") % 3 == 0, ',"error":"server"').otherwise(""), F.lit("}"))
    return L.compile_counts(o.select(F.col("o_orderkey").alias("script_id"), report.alias("report")))


# Scalars


@query("sf1_sf3_rounding", r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 10 + 0.5) / 10 AS r1, floor(-l_quantity / 2 + 0.5) AS r0,
  regexp_replace(regexp_replace(CAST(CAST(floor(l_discount * 100 * 100 + 0.5) / 100 AS DECIMAL(38,2)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '') || '%' AS pct, nullif(l_tax, 0) AS or_null FROM lineitem""")
def rounding(spark, d):
    line = T.table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.js_round(F.col("l_extendedprice"), 1).alias("r1"), S.js_round(-F.col("l_quantity") / 2).alias("r0"), S.pct_text(F.col("l_discount") * 100).alias("pct"), S.or_null(F.col("l_tax")).alias("or_null"))


@query("sf4_parse_price", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 4 = 1 THEN -1 ELSE 1 END * (o_custkey + 0.5::DOUBLE) END AS price FROM orders")
def parse_price(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "n/a").when(k == 1, F.concat(F.lit("$ -"), F.col("o_custkey").cast("string"), F.lit(".5-9"))).when(k == 2, F.concat(F.lit("USD "), F.col("o_custkey").cast("string"), F.lit(".5.7 x"))).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(",.5")))
    return o.select("o_orderkey", S.parse_price(text).alias("price"))


@query("sf5_sf6_sf7_texts", """SELECT p_partkey, 'P' || p_partkey AS plain, p_size || '.5' AS last, '-' || p_size AS change, '1,' || p_size || '%' AS change_percent,
  CASE WHEN p_size % 2 = 0 THEN 'NYMEX:' || p_size ELSE p_brand END AS alert_symbol FROM part""")
def texts(spark, d):
    p = T.table(spark, d, "part")
    size = F.col("p_size").cast("string")
    cells = F.array(F.col("p_brand"), F.concat(size, F.lit(".5")), F.lit("x1"), F.concat(F.lit("-"), size), F.concat(F.lit("1,"), size, F.lit("%")))
    alert = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('={"symbol":"NYMEX:'), size, F.lit('"}'))).otherwise(F.col("p_brand"))
    return p.select("p_partkey", S.strip_em(F.concat(F.lit("<em>P</em>"), F.col("p_partkey").cast("string"))).alias("plain"), S.watch_values(cells).alias("w"), S.alert_symbol(alert).alias("alert_symbol")).select("p_partkey", "plain", "w.*", "alert_symbol")


@query("sf8_sf13_dates", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 1000 WHEN event_id % 3 = 0 THEN NULL ELSE epoch(ts::DATE)::BIGINT END AS seconds, strftime(ts, '%Y-%m-%d') AS date FROM events")
def dates(spark, d):
    e = T.table(spark, d, "events")
    k = F.col("event_id")
    text = F.when(k % 2 == 0, (k * 1000).cast("string")).when(k % 3 == 0, "soon").otherwise(S.date_key(F.col("ts")))
    return e.select("event_id", S.to_epoch(text).alias("seconds"), S.date_key(F.col("ts")).alias("date"))


@query("sf10_classify_console", r"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '12:30:05 Error: ' WHEN 1 THEN '2024-01-02 10:11:12 Compiling ' ELSE '' END || text AS line, CASE WHEN turn % 4 = 2 THEN 'msg warn' ELSE 'msg' END AS css FROM conversations)
SELECT conv_id, turn, nullif(regexp_extract(line, '^([0-9]{4}-[0-9]{2}-[0-9]{2}\s+)?[0-9]{2}:[0-9]{2}:[0-9]{2}'), '') AS timestamp,
  CASE WHEN regexp_matches(substr(line, 1, 30), '(?i)error') THEN 'error' WHEN regexp_matches(substr(line, 1, 40), '(?i)compil') THEN 'compile' WHEN css LIKE '%warn%' THEN 'warning' ELSE 'info' END AS type FROM c""")
def classify_console(spark, d):
    c = T.table(spark, d, "conversations")
    k = F.col("turn") % 4
    line = F.concat(F.when(k == 0, "12:30:05 Error: ").when(k == 1, "2024-01-02 10:11:12 Compiling ").otherwise(""), F.col("text"))
    return c.select("conv_id", "turn", S.classify_console(line, F.when(k == 2, "msg warn").otherwise("msg")).alias("r")).select("conv_id", "turn", "r.*")


@query("set1_union_log", "SELECT o_orderkey, o_orderstatus, NULL::DOUBLE AS amount FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def union_log(spark, d):
    o = T.table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").unionByName(o.where("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_totalprice").alias("amount")), allowMissingColumns=True)
