"""Queries of ordered folds, whose SQL recurs from row to row, and of order books."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import bars as B
from .operators import depth as D
from .operators import renko as R
from .operators import signals as G
from .plans import workflows as P
from .queries import query
from .queries_market import MACHINE, REASON, SCALPER, bars_sql, hourly, r6, rounded
from .queries_reports import DEPTH
from .sources import tables as T
from .streaming import feeds as X

BARS = "WITH RECURSIVE " + bars_sql()
BRICK = 5.0
ROWS = "row_number() OVER (PARTITION BY symbol, resolution ORDER BY ts) AS i"


@query(
    "bar9_renko",
    f"""{BARS}, c AS (SELECT symbol, resolution, ts, close, {ROWS} FROM bars WHERE close IS NOT NULL),
f AS (SELECT symbol, resolution, ts, i, close AS low, close AS high, close AS from_low, close AS from_high, 0::BIGINT AS up, 0::BIGINT AS down FROM c WHERE i = 1
UNION ALL SELECT symbol, resolution, ts, i, CASE WHEN up > 0 THEN h + (up - 1) * {BRICK}::DOUBLE WHEN down > 0 THEN l - down * {BRICK}::DOUBLE ELSE l END,
  CASE WHEN up > 0 THEN h + up * {BRICK}::DOUBLE WHEN down > 0 THEN l - (down - 1) * {BRICK}::DOUBLE ELSE h END, l, h, up, down
  FROM (SELECT c.*, f.low AS l, f.high AS h, greatest(floor((c.close - f.high) / {BRICK}::DOUBLE), 0)::BIGINT AS up, greatest(floor((f.low - c.close) / {BRICK}::DOUBLE), 0)::BIGINT AS down
    FROM f JOIN c ON f.symbol = c.symbol AND f.resolution = c.resolution AND c.i = f.i + 1)),
k AS (SELECT *, coalesce(sum(up + down) OVER (PARTITION BY symbol, resolution ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS made, unnest(range(up + down)) AS j FROM f),
r AS (SELECT symbol, resolution, ts, made + j AS brick_no, CASE WHEN up > 0 THEN from_high + j * {BRICK}::DOUBLE ELSE from_low - j * {BRICK}::DOUBLE END AS open, CASE WHEN up > 0 THEN from_high + (j + 1) * {BRICK}::DOUBLE ELSE from_low - (j + 1) * {BRICK}::DOUBLE END AS close FROM k)
SELECT symbol, resolution, ts, brick_no, {r6("open")}, {r6("close")} FROM r""",
)
def renko(spark, d):
    return rounded(B.renko(hourly(spark, d), BRICK), "open", "close")


@query(
    "bar9_renko_on_grid",
    f"""{BARS}, c AS (SELECT symbol, resolution, ts, close, {ROWS}, first(close ORDER BY ts) OVER (PARTITION BY symbol, resolution) AS a FROM bars WHERE close IS NOT NULL),
g AS (SELECT *, floor((close - a) / {BRICK}::DOUBLE)::BIGINT AS q FROM c),
k AS (SELECT *, q + (close >= a + (q + 1) * {BRICK}::DOUBLE)::BIGINT - (close < a + q * {BRICK}::DOUBLE)::BIGINT AS under FROM g),
f AS (SELECT symbol, resolution, ts, i, a, 0::BIGINT AS low, 0::BIGINT AS high, 0::BIGINT AS start_edge, 0::BIGINT AS way, 0::BIGINT AS bricks FROM k WHERE i = 1
UNION ALL SELECT symbol, resolution, ts, i, a, CASE WHEN up > 0 THEN h + up - 1 WHEN down > 0 THEN l - down ELSE l END, CASE WHEN up > 0 THEN h + up WHEN down > 0 THEN l - down + 1 ELSE h END,
  CASE WHEN up > 0 THEN h ELSE l END, CASE WHEN up > 0 THEN 1 ELSE -1 END, greatest(up, down)
  FROM (SELECT k.*, f.low AS l, f.high AS h, greatest(under - f.high, 0) AS up, greatest(f.low - under - (close > k.a + under * {BRICK}::DOUBLE)::BIGINT, 0) AS down
    FROM f JOIN k ON f.symbol = k.symbol AND f.resolution = k.resolution AND k.i = f.i + 1)),
m AS (SELECT *, coalesce(sum(bricks) OVER (PARTITION BY symbol, resolution ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS made, unnest(range(bricks)) AS j FROM f),
r AS (SELECT symbol, resolution, ts, made + j AS brick_no, a + (start_edge + way * j) * {BRICK}::DOUBLE AS open, a + (start_edge + way * (j + 1)) * {BRICK}::DOUBLE AS close FROM m)
SELECT symbol, resolution, ts, brick_no, {r6("open")}, {r6("close")} FROM r""",
)
def renko_on_grid(spark, d):
    """Chunks of weeks, so that one month of events makes several."""
    return rounded(R.renko_on_grid(hourly(spark, d), BRICK, F.date_trunc("week", "ts")), "open", "close")


FOLD = f"""acts AS (SELECT symbol, resolution, ts, signal, close AS p, {ROWS} FROM sig WHERE signal <> 'flat'),
fold AS (SELECT symbol, resolution, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS side, 0.0::DOUBLE AS size, 0.0::DOUBLE AS filled, 100.0::DOUBLE AS quote_after, 0.0::DOUBLE AS base_after FROM acts WHERE i = 1
UNION ALL SELECT symbol, resolution, i, ts, side, size, CASE side WHEN 'buy' THEN size / p WHEN 'sell' THEN size END, CASE side WHEN 'buy' THEN q - size WHEN 'sell' THEN q + size * p ELSE q END,
  CASE side WHEN 'buy' THEN size / p WHEN 'sell' THEN 0 ELSE b END
  FROM (SELECT *, CASE side WHEN 'buy' THEN round(q * 0.9::DOUBLE, 4) WHEN 'sell' THEN floor(b * 10000) / 10000 END AS size
    FROM (SELECT a.*, f.quote_after AS q, f.base_after AS b, CASE WHEN a.signal = 'buy' AND f.base_after = 0 AND f.quote_after >= 1 AND a.p > 0 THEN 'buy' WHEN a.signal = 'sell' AND f.base_after >= 1 THEN 'sell' END AS side
      FROM fold f JOIN acts a ON a.symbol = f.symbol AND a.resolution = f.resolution AND a.i = f.i + 1))),
orders_made AS (SELECT * FROM fold WHERE side IS NOT NULL)"""


@query("sig4_position_fold", f"""{BARS}, {SCALPER}, {FOLD} SELECT symbol, resolution, ts, side, {r6("size")}, {r6("filled")}, {r6("quote_after")}, {r6("base_after")} FROM orders_made""")
def position_fold(spark, d):
    return rounded(G.position_fold(G.scalper_signal(hourly(spark, d))), "size", "filled", "quote_after", "base_after")


@query(
    "wf5_backtest_accounts",
    f"""{BARS}, {SCALPER}, {FOLD}, e AS (SELECT symbol, count(*) AS orders, last(quote_after ORDER BY ts) AS quote_after, last(base_after ORDER BY ts) AS base_after FROM orders_made GROUP BY 1),
p AS (SELECT symbol, last(close ORDER BY ts) AS last_price FROM bars GROUP BY 1), v AS (SELECT e.*, last_price, quote_after + base_after * coalesce(last_price, 0) AS total_value FROM e JOIN p ON e.symbol = p.symbol)
SELECT symbol, orders, last_price, {r6("quote_after")}, {r6("base_after")}, {r6("total_value")} FROM v""",
)
def backtest_accounts(spark, d):
    return rounded(P.backtest_accounts(hourly(spark, d)), "quote_after", "base_after", "total_value")


@query(
    "wf5_backtest_log",
    f"""{BARS}, {SCALPER}, {MACHINE}, {FOLD}, j AS (SELECT m.*, o.side, o.filled, o.quote_after AS q, o.base_after AS h FROM machine m LEFT JOIN orders_made o ON m.symbol = o.symbol AND m.resolution = o.resolution AND m.ts = o.ts),
k AS (SELECT *, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY symbol, resolution ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100.0::DOUBLE) AS q0,
  coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY symbol, resolution ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS h0 FROM j),
log AS (SELECT symbol, resolution, n AS tick, ts, close AS price, ema8, rsi3, vwap, signal, side, printf('%.4f', CASE side WHEN 'buy' THEN q0 * 0.9::DOUBLE WHEN 'sell' THEN floor(h0 * 10000) / 10000 END) AS size, side IS NOT NULL AS order_placed,
  coalesce(filled, 0) AS filled, coalesce(q, q0) AS quote_after, coalesce(h, h0) AS base_after, CASE WHEN side IS NULL THEN coalesce({REASON}, 'the balance is too small') END AS skip_reason FROM k)
SELECT symbol, resolution, tick, ts, price, {r6("ema8")}, {r6("rsi3")}, {r6("vwap")}, signal, side, size, order_placed, {r6("filled")}, {r6("quote_after")}, {r6("base_after")}, skip_reason FROM log""",
)
def backtest_log(spark, d):
    return rounded(P.backtest_log(hourly(spark, d)), "ema8", "rsi3", "vwap", "filled", "quote_after", "base_after")


@query(
    "wf5_order_stats",
    f"""{BARS}, {SCALPER}, p AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 'flat' THEN signal END IGNORE NULLS) OVER (PARTITION BY symbol, resolution ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'sell') AS b FROM sig),
m AS (SELECT CASE WHEN signal = b THEN 'signal=' || signal || ' but holding=' || CASE b WHEN 'buy' THEN 'base' ELSE 'quote' END || ' (waiting for right side)' WHEN signal = 'flat' THEN 'no signal — conditions not met' END AS skip_reason FROM p)
SELECT skip_reason, count(*) AS total, count(*) FILTER (skip_reason IS NULL) AS placed FROM m GROUP BY 1""",
)
def backtest_order_stats(spark, d):
    from .operators.strategy import order_stats

    return order_stats(P.scalper_backtest(hourly(spark, d)).withColumn("order_placed", F.col("action") != "skip"))


@query(
    "sig9_practice_pnl",
    f"""WITH RECURSIVE {bars_sql("240", key="user_id::VARCHAR")}, t AS (SELECT user_id::VARCHAR AS symbol, ts, event_id AS id, CASE WHEN event_id % 5 < 2 THEN 'buy' WHEN event_id % 5 < 4 THEN 'sell' ELSE 'close' END AS action FROM events),
a AS (SELECT t.symbol AS session, t.symbol, t.ts, t.id, t.action, b.close AS price, row_number() OVER (PARTITION BY t.symbol ORDER BY t.ts, t.id) AS n FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts >= b.ts),
f AS (SELECT symbol, 0::BIGINT AS n, 0::BIGINT AS position, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS realized_pnl, NULL::TIMESTAMP AS ts, NULL::BIGINT AS id, NULL::VARCHAR AS action, NULL::DOUBLE AS price FROM a WHERE n = 1
UNION ALL SELECT a.symbol, a.n, CASE WHEN a.price IS NULL THEN f.position WHEN a.action = 'buy' THEN f.position + 1 WHEN a.action = 'sell' THEN f.position - 1 ELSE 0 END,
  CASE WHEN a.price IS NOT NULL AND ((a.action = 'buy' AND f.position >= 0) OR (a.action = 'sell' AND f.position <= 0)) THEN (f.cost * abs(f.position) + a.price) / (abs(f.position) + 1) ELSE f.cost END,
  f.realized_pnl + CASE WHEN a.price IS NULL THEN 0 WHEN a.action = 'close' THEN f.position * (a.price - f.cost) WHEN a.action = 'buy' AND f.position < 0 THEN f.cost - a.price
    WHEN a.action = 'sell' AND f.position > 0 THEN a.price - f.cost ELSE 0 END, a.ts, a.id, a.action, a.price
  FROM f JOIN a ON a.symbol = f.symbol AND a.n = f.n + 1)
SELECT symbol AS session, symbol, ts, id, action, price, position, {r6("realized_pnl")} FROM f WHERE n > 0""",
)
def practice_pnl(spark, d):
    t = T.ticks(spark, d, "user_id")
    action = F.when(F.col("id") % 5 < 2, "buy").when(F.col("id") % 5 < 4, "sell").otherwise("close")
    actions = t.select(F.col("symbol").alias("session"), "symbol", "ts", "id", action.alias("action"))
    return rounded(G.practice_pnl(actions, B.build_bars(T.ticks(spark, d, "user_id"), "240")), "realized_pnl")


# Order books and drawings

BOOK = "string_agg(CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) || 'x' || CAST(CAST(size AS DECIMAL(18,2)) AS VARCHAR), ' ' ORDER BY price {o}, size {o}) FILTER (side = '{s}')"


@query("agg3_depth_book", f"""{DEPTH} SELECT symbol, coalesce({BOOK.format(o="DESC", s="bid")}, '') AS bids, coalesce({BOOK.format(o="ASC", s="ask")}, '') AS asks FROM levels GROUP BY 1""")
def depth_book(spark, d):
    number = lambda c: c.cast("decimal(18,2)").cast("string")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(number(x["price"]), F.lit("x"), number(x["size"]))), " ").alias(c)
    return D.depth_book(D.classify_depth(T.depth_rows(spark, d))).select("symbol", text("bids"), text("asks"))


@query(
    "agg4_levels_or_raw",
    f"""{DEPTH}, r AS (SELECT symbol, row_index, size AS price, row_number() OVER (PARTITION BY symbol ORDER BY row_index) AS n FROM rows WHERE size > 0 AND symbol::BIGINT % 2 = 0)
SELECT symbol, row_index, side, price, size FROM levels WHERE symbol::BIGINT % 2 = 1 UNION ALL SELECT symbol, row_index, NULL, price, NULL FROM r WHERE n <= 50""",
)
def levels_or_raw(spark, d):
    """Books of even suppliers have no price that can be read, only numbers in other cells."""
    rows = T.depth_rows(spark, d)
    blind = rows.withColumn("price_text", F.when(F.col("symbol").cast("long") % 2 == 0, "n/a").otherwise(F.col("price_text")))
    return D.levels_or_raw(blind, rows.select("symbol", "row_index", F.col("size_text").alias("price_text")))


@query(
    "st5_line_changes",
    """WITH l AS (SELECT 'Study ' || l_suppkey AS study, date_trunc('quarter', l_shipdate)::TIMESTAMP AS snapshot, CASE WHEN l_returnflag = 'A' OR floor(l_quantity) = l_linenumber THEN floor(l_quantity) ELSE coalesce(nullif(floor(l_quantity), 0), l_linenumber) END AS level FROM lineitem),
e AS (SELECT study, snapshot, list(DISTINCT level ORDER BY level DESC) AS levels FROM l GROUP BY 1, 2), b AS (SELECT *, lag(levels) OVER (PARTITION BY study ORDER BY snapshot) AS before FROM e)
SELECT study, snapshot, len(levels) AS n_levels, list_sum(levels) AS total FROM b WHERE before IS NULL OR before <> levels""",
)
def line_changes(spark, d):
    """Lines of each supplier's quarter, on change of their levels."""
    line = T.table(spark, d, "lineitem")
    y = F.floor("l_quantity").cast("double")
    lines = line.select(
        F.concat(F.lit("Study "), F.col("l_suppkey").cast("string")).alias("study"),
        F.date_trunc("quarter", "l_shipdate").cast("timestamp_ntz").alias("snapshot"),
        y.alias("y1"),
        F.when(F.col("l_returnflag") == "A", y).otherwise(F.col("l_linenumber").cast("double")).alias("y2"),
    )
    total = F.aggregate("levels", F.lit(0.0), lambda a, x: a + x)
    return X.drawing_changes_batch(lines, "snapshot").select("study", "snapshot", F.size("levels").cast("long").alias("n_levels"), total.alias("total"))


@query(
    "st5_label_changes",
    """WITH l AS (SELECT 'Study ' || (conv_id % 10) AS study, (TIMESTAMP '2024-01-01' + to_minutes(conv_id // 10)) AS snapshot, turn AS seq, role AS text FROM conversations WHERE role <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY study, snapshot ORDER BY seq) AS r FROM l), p AS (SELECT study, snapshot, list(text ORDER BY r) AS payload FROM r WHERE r <= 50 GROUP BY 1, 2),
b AS (SELECT *, lag(payload) OVER (PARTITION BY study ORDER BY snapshot) AS before FROM p)
SELECT study, snapshot, len(payload) AS n_labels, array_to_string(payload, ' ') AS labels FROM b WHERE before IS NULL OR before <> payload""",
)
def label_changes(spark, d):
    """A conversation is a snapshot of one of ten studies, its roles are the labels."""
    c = T.table(spark, d, "conversations")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.floor(F.col("conv_id") / 10).cast("int"))
    labels = c.select(F.concat(F.lit("Study "), (F.col("conv_id") % 10).cast("string")).alias("study"), at.alias("snapshot"), F.col("turn").alias("seq"), F.col("role").alias("text"))
    return X.drawing_payloads_batch(labels, "labels").select("study", "snapshot", F.size("payload").cast("long").alias("n_labels"), F.array_join("payload", " ").alias("labels"))


@query(
    "st5_table_changes",
    """WITH c AS (SELECT 'Study ' || l_suppkey AS study, date_trunc('quarter', l_shipdate)::TIMESTAMP AS snapshot, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 2 ELSE 0 END AS tid, l_linenumber % 2 AS row, l_partkey % 2 AS col,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS text, printf('%012d.%012d.%012d.%03d', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS seq FROM lineitem),
w AS (SELECT study, snapshot, tid, row, col, last(text ORDER BY seq) AS text FROM c GROUP BY ALL), r AS (SELECT study, snapshot, tid, row, string_agg(text, chr(9) ORDER BY col) AS line FROM w GROUP BY ALL),
p AS (SELECT study, snapshot, list(line ORDER BY tid, row) AS payload FROM r GROUP BY ALL), b AS (SELECT *, lag(payload) OVER (PARTITION BY study ORDER BY snapshot) AS before FROM p)
SELECT study, snapshot, len(payload) AS n_rows, array_to_string(payload, '/') AS shown FROM b WHERE before IS NULL OR before <> payload""",
)
def table_changes(spark, d):
    """Each supplier's quarter is a snapshot of tables whose cells are written by its line items."""
    line = T.table(spark, d, "lineitem")
    cells = line.select(
        F.concat(F.lit("Study "), F.col("l_suppkey").cast("string")).alias("study"),
        F.date_trunc("quarter", "l_shipdate").cast("timestamp_ntz").alias("snapshot"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 2).alias("tid"),
        (F.col("l_linenumber") % 2).alias("row"),
        (F.col("l_partkey") % 2).alias("col"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("text"),
        F.format_string("%012d.%012d.%012d.%03d", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("seq"),
    )
    shown = X.drawing_payloads_batch(cells, "tables")
    return shown.select("study", "snapshot", F.size("payload").cast("long").alias("n_rows"), F.array_join("payload", "/").alias("shown"))
