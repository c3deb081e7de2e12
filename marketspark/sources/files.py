"""Readers and writers of bars, candles, rules, logs and sessions."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.scalars import or_zero
from .scratch import delete
from .tables import BAR

TRADE_LOG = (
    "timestamp string, symbol string, timeframe string, tick long, price double, side string, size string, label string, orderId string, orderPlaced boolean, "
    "ema8 double, rsi3 double, vwap double, signal string, skipped boolean, skipReason string, reason string, filledQty double, "
    "indicators struct<price:double,ema_21:double,ema_50:double,ema_200:double,rsi_14:double,macd_line:double,signal_line:double,macd_histogram:double>, "
    "conditions map<string,struct<required:boolean,actual:boolean,result:string>>, verdict string, blocked_reasons array<string>, "
    "response struct<code:string,msg:string,requestTime:long,data:string>"
)
DEFAULT_TIMEFRAME = "240"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars of one schema; rows without prices are skipped, volume is 0 where missing or NaN."""
    raw = spark.read.schema(BAR).format(fmt).option("header", "true").load(path)
    return clean_bars(raw)


def clean_bars(raw: DataFrame) -> DataFrame:
    has = F.coalesce("open", "high", "low", "close").isNotNull() & F.col("ts").isNotNull()
    return raw.where(has).withColumn("volume", or_zero(F.col("volume")))


def load_rules(spark: SparkSession, paths: list[str]) -> dict:
    """The first of the files (or folders of one file) that exists, as a dict; its path is in 'path'.

    A file that can't be parsed or has no watchlist raises a ValueError that names it.
    """
    for path in paths:
        found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
        try:
            rows = found.load(path).select(F.col("content").cast("string").alias("text")).collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        if not rows:
            continue
        try:
            rules = json.loads(rows[0]["text"])
        except ValueError as error:
            raise ValueError(f"{path} isn't valid JSON: {error}") from error
        if not rules.get("watchlist"):
            raise ValueError(f"{path} has no watchlist")
        return {"default_timeframe": DEFAULT_TIMEFRAME} | rules | {"path": path}
    raise FileNotFoundError(f"none of these rules files exists: {', '.join(paths)}")


def watchlist(spark: SparkSession, rules: dict) -> DataFrame:
    """symbol, seq of the rules' watchlist."""
    return spark.createDataFrame([(s, k) for k, s in enumerate(rules["watchlist"])], "symbol string, seq int")


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records of several shapes, under one schema."""
    return spark.read.schema(TRADE_LOG).option("multiLine", "true").json(path)


def append_log(log: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Adds rows to a log that is partitioned by date; what is there isn't read or rewritten."""
    log.withColumn("date", F.substring(F.col(ts).cast("string"), 1, 10)).write.mode("append").partitionBy("date").parquet(path)


def merge_sessions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with new ones put in by date: saved_at and brief are replaced, other columns survive."""
    extra = [c for c in stored.columns if c not in ("date", "saved_at", "brief")]
    n = new.select("date", F.col("saved_at").alias("_s"), F.col("brief").alias("_b"), F.lit(True).alias("_new"))
    joined = stored.join(n, "date", "full_outer")
    is_new = F.coalesce("_new", F.lit(False))
    return joined.select("date", F.when(is_new, F.col("_s")).otherwise(F.col("saved_at")).alias("saved_at"), F.when(is_new, F.col("_b")).otherwise(F.col("brief")).alias("brief"), *extra)


def save_session(new: DataFrame, path: str, stored_schema: str = "saved_at string, brief string, date string") -> None:
    """Writes sessions over those of their dates only; the folder is partitioned by date.

    Of what is stored, only partitions of the new dates are read, and only they are written:
    the range of dates is known before the scan, and the dates themselves prune inside it.
    No sessions: nothing is written. A session without a date: ValueError.
    """
    spark = new.sparkSession
    first, last, undated = new.agg(F.min("date"), F.max("date"), F.count_if(F.col("date").isNull())).first()
    if undated:
        raise ValueError("sessions without a date can't be stored")
    if first is None:
        return
    in_range = F.col("date").between(first, last)
    try:
        stored = stored_sessions(spark, path, stored_schema).where(in_range).join(new.where(in_range).select("date").distinct(), "date", "left_semi")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], stored_schema)
    merged = merge_sessions(stored, new)
    # Read and write meet in one folder, so the dates' rows are written beside it first.
    beside = f"{path.rstrip('/')}.merge-{uuid.uuid4().hex}"
    merged.write.parquet(beside)
    try:
        spark.read.schema(merged.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    finally:
        delete(spark, beside)


def stored_sessions(spark: SparkSession, path: str, stored_schema: str = "saved_at string, brief string, date string") -> DataFrame:
    """The sessions that save_session() has written, dates as text."""
    return spark.read.schema(stored_schema).parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that append_log() has written; date, of its folders, is text."""
    return spark.read.schema(f"{schema}, date string").parquet(path)


def write_jsonl_stream(stream: DataFrame, label: str, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of JSON lines with _ts (milliseconds) and _stream; start() it."""
    marked = stream.withColumns({"_ts": F.unix_millis(F.current_timestamp()), "_stream": F.lit(label)})
    return marked.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
