"""Queries that write files, read them back and return what they hold, with their SQL.

The files are in the shared folder (``sources/scratch.py``) and stay, as the returned rows are
read from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import query
from .queries_market import DAILY, TICKS, _sessions
from .sources import files as R
from .sources import tables as T
from .sources.scratch import new_folder

DAY_MS = 86_400_000
RECORDS = 10_000  # of one file of a trade log


@query(
    "src4_read_trade_log",
    f"""WITH {TICKS.format(key='event_type')} SELECT symbol, id AS tick, CASE WHEN id % 3 <> 2 THEN price END AS price, CASE id % 3 WHEN 0 THEN CASE WHEN price >= 50 THEN 'sell' ELSE 'buy' END END AS side,
  CASE WHEN id % 3 = 0 THEN 'order' || id END AS order_id, CASE WHEN id % 3 = 0 THEN price >= 10 END AS order_placed, CASE WHEN id % 3 = 1 THEN CASE WHEN price > 20 THEN 'ALLOWED' ELSE 'BLOCKED' END END AS verdict,
  CASE WHEN id % 3 = 1 THEN CASE WHEN price > 20 THEN '' WHEN size > 5 THEN 'price,size' ELSE 'price' END END AS blocked_reasons, CASE WHEN id % 3 = 1 THEN price > 20 END AS price_condition,
  CASE WHEN id % 3 = 2 THEN '4' || (id % 100) END AS response_code FROM ticks""",
)
def read_trade_log(spark, d):
    """Arrays of records of three shapes: orders, verdicts of the safety check, replies of the exchange."""
    path = new_folder(spark, "trade-log")
    t = T.ticks(spark, d)
    shape, price = F.col("id") % 3, F.col("price")
    reasons = F.when(price > 20, F.array().cast("array<string>")).when(F.col("size") > 5, F.array(F.lit("price"), F.lit("size"))).otherwise(F.array(F.lit("price")))
    condition = F.struct(F.lit(True).alias("required"), (price > 20).alias("actual"), F.lit("price over 20").alias("result"))
    record = F.struct(
        "symbol",
        F.col("id").alias("tick"),
        F.when(shape != 2, price).alias("price"),
        F.when(shape == 0, F.when(price >= 50, "sell").otherwise("buy")).alias("side"),
        F.when(shape == 0, F.concat(F.lit("order"), F.col("id").cast("string"))).alias("orderId"),
        F.when(shape == 0, price >= 10).alias("orderPlaced"),
        F.when(shape == 1, F.when(price > 20, "ALLOWED").otherwise("BLOCKED")).alias("verdict"),
        F.when(shape == 1, reasons).alias("blocked_reasons"),
        F.when(shape == 1, F.create_map(F.lit("price"), condition)).alias("conditions"),
        F.when(shape == 2, F.struct(F.concat(F.lit("4"), (F.col("id") % 100).cast("string")).alias("code"))).alias("response"),
    )
    # Fields that are null aren't written, so the records differ in shape. One array, and one task, for each file.
    part = F.floor(F.col("id") / RECORDS).alias("part")
    t.groupBy(part).agg(F.to_json(F.collect_list(record)).alias("value")).write.partitionBy("part").text(path)
    log = R.read_trade_log(spark, path)
    return log.select(
        "symbol", "tick", "price", "side", F.col("orderId").alias("order_id"), F.col("orderPlaced").alias("order_placed"), "verdict",
        F.array_join("blocked_reasons", ",").alias("blocked_reasons"), F.col("conditions")["price"]["actual"].alias("price_condition"), F.col("response.code").alias("response_code"),
    )


@query("snk1_append_log", f"WITH {TICKS.format(key='event_type')} SELECT id AS tick, symbol, price, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS run FROM ticks")
def append_log(spark, d):
    """Two runs that append to the same dates."""
    path = new_folder(spark, "log")
    for run in (1, 2):
        mine = T.ticks(spark, d).where(F.pmod("id", F.lit(2)) == run - 1)
        R.append_log(mine.select("symbol", F.col("ts").cast("string").alias("timestamp"), F.col("id").alias("tick"), "price", F.lit(run).alias("run")), path)
    return R.read_log(spark, path, "symbol string, timestamp string, tick long, price double, run int").select("tick", "symbol", "price", "date", "run")


@query(
    "snk2_save_session",
    f"""{DAILY}, b AS (SELECT date, min(bias) AS low, max(bias) AS high, count(*) AS symbols FROM s GROUP BY 1)
SELECT date, CASE WHEN date BETWEEN '2024-01-08' AND '2024-01-20' THEN 'later' ELSE 'first' END AS saved_at, CASE WHEN date BETWEEN '2024-01-08' AND '2024-01-20' THEN high ELSE low END AS brief, CASE WHEN date < '2024-01-15' OR date > '2024-01-20' THEN symbols END AS symbols FROM b""",
)
def save_session(spark, d):
    """Sessions of all dates but a week's, then of that week and the one before: what isn't replaced survives."""
    path, schema = new_folder(spark, "sessions"), "saved_at string, brief string, symbols long, date string"
    days = _sessions(spark, d).groupBy("date").agg(F.min("bias").alias("low"), F.max("bias").alias("high"), F.count(F.lit(1)).alias("symbols"))
    first = days.where("date < '2024-01-15' or date > '2024-01-20'").select(F.lit("first").alias("saved_at"), F.col("low").alias("brief"), "symbols", "date")
    first.write.partitionBy("date").parquet(path)
    R.save_session(days.where("date between '2024-01-08' and '2024-01-20'").select("date", F.lit("later").alias("saved_at"), F.col("high").alias("brief")), path, schema)
    return R.stored_sessions(spark, path, schema).select("date", "saved_at", "brief", "symbols")


@query("snk3_jsonl_stream", f"WITH {TICKS.format(key='event_type')} SELECT symbol, id, price, strftime(ts, '%Y-%m-%d %H:%M') AS minute, 'ticks' AS _stream, true AS stamped FROM ticks")
def jsonl_stream(spark, d):
    """All events as a stream into JSON lines, up to its end."""
    path = new_folder(spark, "jsonl")
    schema = T.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.substring(F.col("ts").cast("string"), 1, 16).alias("minute"))
    begun = F.unix_millis(F.current_timestamp())
    R.write_jsonl_stream(rows, "ticks", f"{path}/lines", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema("symbol string, id long, price double, minute string, _ts long, _stream string").json(f"{path}/lines")
    return lines.select("symbol", "id", "price", "minute", "_stream", F.col("_ts").between(begun - DAY_MS, begun + DAY_MS).alias("stamped"))
