"""Feeds that emit on change only, sampled feeds and event-time bars; each with its batch twin."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import KEY, PRICES, bucket, in_order
from ..operators.drawings import stream_labels, stream_levels, stream_table_rows, study_filter
from ..operators.signals import position_machine, scalper_signal
from ..operators.studies import numeric_values, visible_only

#: Milliseconds between samples of each feed: fixed values.
INTERVALS = {"quote": 300, "bars": 500, "values": 500, "lines": 1000, "labels": 1000, "tables": 2000, "all": 500}
LABELS = 50  # of a study, in its feed


def payload_hash(columns: list[str]) -> Column:
    """One number for a payload; null where all of it is null, so that nothing is emitted for it."""
    return F.when(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull(), F.xxhash64(*columns))


def changes_only_batch(df: DataFrame, keys: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """Rows whose payload differs from the one before it in their feed; rows without payload neither emit nor count."""
    some = df.withColumn("_h", payload_hash(payload)).where("_h is not null")
    before = F.lag("_h").over(Window.partitionBy(*keys).orderBy(*order))
    return some.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("_h"))).drop("_h", "_b")


def changes_only(stream: DataFrame, keys: list[str], payload: list[str], order: str) -> DataFrame:
    """The stream's rows that change their feed's payload, in the order of ``order`` inside each micro-batch.

    State is one number for each key; feeds are bounded by the symbols watched, so it is kept.
    """
    schema = stream.schema
    hashed = stream.withColumn("_h", payload_hash(payload)).where("_h is not null")

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for h in rows["_h"]:
            keep.append(last is None or h != last)
            last = h
        if last is not None:
            state.update((int(last),))
        yield rows[keep].drop(columns="_h")

    return hashed.groupBy(*keys).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def sample_latest(df: DataFrame, keys: list[str], every_ms: int, values: list[str], tie: str, ts: str = "ts") -> DataFrame:
    """The latest row of each key in each interval, equal times by the whole number tie; works on streams with a watermark and on tables."""
    latest = [F.max_by(v, in_order(ts, tie)).alias(v) for v in values]
    return df.groupBy(F.window(ts, f"{every_ms} milliseconds").alias("_w"), *keys).agg(*latest).select(*keys, F.col("_w.start").alias("sampled_at"), *values)


def streaming_bars(ticks: DataFrame, resolution_minutes: int, watermark: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (ts a timestamp), each appended when the watermark has passed its end."""
    at = in_order()
    timed = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", f"{resolution_minutes} minutes").alias("_w"), "symbol")
    bars = timed.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.lit(str(resolution_minutes)).alias("resolution"), F.col("_w.start").alias("ts"), *PRICES)


def sliding_stats(ticks: DataFrame, size: str = "30 minutes", slide: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """symbol, ts (start), ticks, vwap over sliding windows."""
    source = ticks if watermark is None else ticks.withWatermark("ts", watermark)
    volume = F.sum("size")
    return source.groupBy("symbol", F.window("ts", size, slide).alias("_w")).agg(F.count(F.lit(1)).alias("n_ticks"), F.try_divide(F.sum(F.col("price") * F.col("size")), F.nullif(volume, F.lit(0.0))).alias("vwap")).select("symbol", F.col("_w.start").alias("ts"), "n_ticks", "vwap")


def session_bars(ticks: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """A bar for each run of ticks without a gap: symbol, ts, end, prices and volume."""
    source = ticks if watermark is None else ticks.withWatermark("ts", watermark)
    at = in_order()
    return (
        source.groupBy("symbol", F.session_window("ts", gap).alias("_w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.col("_w.start").alias("ts"), F.col("_w.end").alias("session_end"), *PRICES)
    )


def stream_quotes_batch(bars: DataFrame) -> DataFrame:
    """Quotes on change, of bars in order."""
    return changes_only_batch(bars, list(KEY), list(PRICES), ["ts"])


def stream_bars_batch(bars: DataFrame, at: str = "ts") -> DataFrame:
    """Changed bars with new_bar: whether the bar's time is another than in the feed's row before. at: orders the feed."""
    changed = changes_only_batch(bars, list(KEY), ["ts", *PRICES], [at])
    before = F.lag("ts").over(Window.partitionBy(*KEY).orderBy(at))
    return changed.withColumn("new_bar", before.isNull() | (before != F.col("ts")))


def forming_bars(parts: DataFrame, resolution: str) -> DataFrame:
    """parts (finer bars) as states of the bar of the resolution that they are in: part_ts (the part's time), ts (the bar's), prices so far."""
    w = Window.partitionBy("symbol", "_bar").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    so_far = [F.first("open").over(w).alias("open"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), F.col("close"), F.sum("volume").over(w).alias("volume")]
    return parts.withColumn("_bar", bucket("ts", resolution)).select("symbol", F.lit(resolution).alias("resolution"), F.col("ts").alias("part_ts"), F.col("_bar").alias("ts"), *so_far)


def stream_values_batch(values: DataFrame) -> DataFrame:
    """Numeric values of visible studies, on change: symbol, study, title, value in the order of seq."""
    return changes_only_batch(numeric_values(visible_only(values)), ["symbol", "study", "title"], ["value"], ["seq"])


def drawing_feed(df: DataFrame, kind: str, study: str = "") -> DataFrame:
    """What a feed of lines, labels or tables holds of drawings whose study matches without case."""
    some = study_filter(df, study, case_sensitive=False)
    return {"lines": stream_levels, "labels": stream_labels, "tables": stream_table_rows}[kind](some)


def drawing_changes_batch(df: DataFrame, snapshot: str) -> DataFrame:
    """Levels of each study's lines at each snapshot, where they differ from those of the study's snapshot before."""
    each = stream_levels(df, (snapshot, "study"))
    return changes_only_batch(each, ["study"], ["levels"], [snapshot])


DRAWING_COLUMNS = {"lines": ("y1 double", "y2 double"), "labels": ("seq long", "text string"), "tables": ("tid long", "row long", "col long", "text string", "seq string")}


def drawing_payload(kind: str, rows: pd.DataFrame) -> list[str]:
    """What one snapshot of a study shows: levels, label texts or table rows (cells by tabs), as in the feeds of drawing_feed."""
    if kind == "lines":
        first, second = rows["y1"].to_numpy(float), rows["y2"].to_numpy(float)
        level = np.where((first == second) | ~((first == 0) | np.isnan(first)), first, second)
        return [str(float(x)) for x in sorted(set(level[~np.isnan(level)].tolist()), reverse=True)]
    if kind == "labels":
        some = rows[rows["text"].fillna("") != ""].sort_values("seq", kind="stable")
        return some["text"].head(LABELS).tolist()
    cells = rows.assign(tid=rows["tid"].fillna(0)).sort_values("seq", kind="stable").drop_duplicates(["tid", "row", "col"], keep="last")
    cells = cells.assign(text=cells["text"].fillna("")).sort_values(["tid", "row", "col"])
    return ["\t".join(r["text"]) for _, r in cells.groupby(["tid", "row"], sort=True)]


class DrawingChanges(StatefulProcessor):
    """Per study: the hash of what was emitted last, kept for a time to live, so that studies that are gone leave no state."""

    def __init__(self, kind: str, ttl_ms: int | None):
        self.kind, self.ttl_ms = kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows))
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for snapshot, part in whole.groupby("snapshot", sort=True):
            payload = drawing_payload(self.kind, part)
            digest = hashlib.blake2b("\n".join(f"{len(x)}:{x}" for x in payload).encode(), digest_size=16).hexdigest()
            if payload and digest != last:
                out.append((key[0], snapshot, payload))
                last = digest
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["study", "snapshot", "payload"])

    def close(self) -> None:
        pass


def drawing_changes(stream: DataFrame, kind: str, study: str = "", ttl_ms: int | None = 7 * 86_400_000) -> DataFrame:
    """study, snapshot, payload (array of texts) of a stream of lines, labels or tables, on change of what the study shows.

    The rows of a study's snapshot must come in one micro-batch, and snapshots in order over
    micro-batches; inside one they are sorted. Snapshots that show nothing neither emit nor count.
    State is a digest for each study, in RocksDB, which forgets studies silent for ttl_ms: such a
    study's next snapshot is emitted anew. The session must use the RocksDB state store. With a
    time to live Spark makes batches without data for ever, so a run that is to end when its input
    does needs spark.sql.streaming.noDataMicroBatches.enabled=false.
    """
    names = [c.split()[0] for c in DRAWING_COLUMNS[kind]]
    kinds = [c.split()[1] for c in DRAWING_COLUMNS[kind]]
    some = study_filter(stream, study, case_sensitive=False).select("study", "snapshot", *(F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))
    moment = stream.schema["snapshot"].dataType.simpleString()
    processor = DrawingChanges(kind, ttl_ms)
    return some.groupBy("study").transformWithStateInPandas(processor, f"study string, snapshot {moment}, payload array<string>", "append", "processingTime" if ttl_ms else "none")


def drawing_payloads_batch(df: DataFrame, kind: str, study: str = "") -> DataFrame:
    """The batch twin of drawing_changes: study, snapshot, payload where it differs from the study's snapshot before."""
    keys = ("study", "snapshot")
    some = study_filter(df, study, case_sensitive=False)
    if kind == "lines":
        shown = stream_levels(some, keys).select(*keys, F.transform("levels", lambda x: x.cast("string")).alias("payload"))
    elif kind == "labels":
        ranked = some.where(F.coalesce("text", F.lit("")) != "").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("_r") <= LABELS)
        shown = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "text"))).alias("_t")).select(*keys, F.transform("_t", lambda x: x["text"]).alias("payload"))
    else:
        cells = some.withColumn("tid", F.coalesce("tid", F.lit(0)).cast("long")).groupBy(*keys, "tid", "row", "col").agg(F.coalesce(F.max_by("text", "seq"), F.lit("")).alias("text"))
        rows = cells.groupBy(*keys, "tid", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("_c"))
        line = F.array_join(F.transform("_c", lambda c: c["text"]), "\t")
        shown = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tid", "row", line.alias("line")))).alias("_l")).select(*keys, F.transform("_l", lambda x: x["line"]).alias("payload"))
    return changes_only_batch(shown, ["study"], ["payload"], ["snapshot"])


def stream_panes_batch(panes: DataFrame, bars: DataFrame) -> DataFrame:
    """All panes of each layout at each bar time, on change of any price or volume: layout, ts, n_panes, panes.

    panes: array of struct(pane_index, symbol, prices), by pane_index.
    """
    joined = panes.join(bars, list(KEY))
    each = joined.groupBy("layout", "ts").agg(F.count(F.lit(1)).alias("n_panes"), F.sort_array(F.collect_list(F.struct("pane_index", "symbol", *PRICES))).alias("panes"))
    return changes_only_batch(each, ["layout"], ["panes"], ["ts"])


def stream_signals(bars: DataFrame, lookback: int = 30) -> DataFrame:
    """symbol, ts, close, signal, holding of a stream of bars: the last bars and the position are the state.

    Bars of a symbol must come in order over micro-batches; inside one they are sorted.
    """
    names = ["ts", "open", "high", "low", "close", "volume"]

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, holding = (list(map(tuple, state.get[0])), state.get[1]) if state.exists else ([], "quote")
        out = []
        for row in pd.concat(parts).sort_values("ts")[names].itertuples(index=False):
            held = [*held, (row.high, row.low, row.close, row.volume)][-lookback:]
            signal = scalper_rule([h[2] for h in held], held)
            if (signal, holding) in (("buy", "quote"), ("sell", "base")):
                holding = "base" if signal == "buy" else "quote"
            out.append((key[0], row.ts, row.close, signal, holding))
        state.update(([list(h) for h in held], holding))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "signal", "holding"])

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, close double, signal string, holding string", "held array<array<double>>, holding string", "append", GroupStateTimeout.NoTimeout)


def scalper_rule(closes: list[float], bars: list[tuple[float, float, float, float]]) -> str:
    """The scalper's signal for the last of these bars (high, low, close, volume)."""
    last, k, average = closes[-1], 2 / 9, closes[0]
    for c in closes[1:]:
        average = c * k + average * (1 - k)
    steps = [b - a for a, b in zip(closes[-4:-1], closes[-3:], strict=True)] if len(closes) >= 4 else []
    losses = sum(-s for s in steps if s < 0)
    strength = 50.0 if not steps else 100.0 if losses == 0 else 100 - 100 / (1 + sum(s for s in steps if s > 0) / losses)
    volume = sum(b[3] for b in bars)
    price = last if volume == 0 else sum((h + lo + c) / 3 * v for h, lo, c, v in bars) / volume
    if last > price and last > average and strength < 30:
        return "buy"
    return "sell" if last < price and last < average and strength > 70 else "flat"


def stream_signals_batch(bars: DataFrame) -> DataFrame:
    """The batch twin of stream_signals: symbol, ts, close, signal, holding (after the bar)."""
    held = position_machine(scalper_signal(bars))
    holding = F.when(F.col("action") == "buy", "base").when(F.col("action") == "sell", "quote").otherwise(F.col("holding_before"))
    return held.select("symbol", "ts", "close", "signal", holding.alias("holding"))
