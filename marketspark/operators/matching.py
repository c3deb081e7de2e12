"""Joins: as-of, range, grid and look-up. Ranges always have an equality beside them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEY, latest_bars
from .dyadic import piece_of, pieces, pieces_of
from .recurrence import places


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str], tie: str | None = None, chunk: str = "day") -> DataFrame:
    """left with values of the last right row at or before it, null if there is none.

    Time is cut into chunks (a unit of date_trunc). Inside a key's chunk both sides are sorted
    once, right rows before left rows of the same time, and the last one seen is carried on;
    before the chunk's first right row that is the last of its earlier chunks, for which only
    one row for each chunk goes over the key's whole time. No range join.
    """
    held = F.struct(*(F.col(v) for v in values))
    r = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("string").alias("_tie"), held.alias("_v"))
    columns = left.columns
    row = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*columns).alias("_row"))
    both = r.unionByName(row, allowMissingColumns=True).withColumn("_chunk", F.date_trunc(chunk, "_t"))
    last = F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", "_tie")))
    earlier = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy("_k", "_chunk").agg(last.alias("_last")).select(F.col("_k").alias("_k2"), F.col("_chunk").alias("_c2"), F.last("_last", ignorenulls=True).over(earlier).alias("_held"))
    w = Window.partitionBy("_k", "_chunk").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    joined = out.join(starts, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_chunk").eqNullSafe(F.col("_c2")))
    found = F.coalesce("_v", "_held")
    return joined.select("_row.*", *(found[v].alias(v) for v in values))


def htf_align(low: DataFrame, high: DataFrame, seconds: int, values: list[str]) -> DataFrame:
    """low with values of the last higher bar that has closed: usable from its start plus its seconds."""
    closed = high.withColumn("_usable", F.col("ts") + F.expr(f"INTERVAL '{seconds}' SECOND"))
    return asof_join(low, closed, "symbol", "ts", "_usable", values)


def visible_range(bars: DataFrame, start, end) -> DataFrame:
    """Bars from start to end, both included; without a bar from start on, from the first; without one up to end, to the last.

    The range reaches the scan; only symbols that lie wholly outside of it are read again.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = bars.where((F.col("ts") >= first) & (F.col("ts") <= last))
    extremes = bars.groupBy(*KEY).agg(F.min("ts").alias("_min"), F.max("ts").alias("_max"))
    outside = extremes.where((F.col("_max") < first) | (F.col("_min") > last))
    low = F.when(F.col("_max") < first, F.col("_min")).otherwise(first)
    high = F.when(F.col("_min") > last, F.col("_max")).otherwise(last)
    more = bars.join(outside, list(KEY)).where(F.col("ts").between(low, high)).select(*bars.columns)
    return inside.unionByName(more)


def around_date(bars: DataFrame, anchors: DataFrame, seconds_per_bar: int, half_bars: int = 25) -> DataFrame:
    """Bars of each anchor (symbol, anchor_ts) within half_bars bars of it.

    Time is cut into spans of the half window, so the join is an equality on symbol and span.
    """
    half = half_bars * seconds_per_bar
    span = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / half)
    near = anchors.withColumn("_span", F.explode(F.array(span("anchor_ts") - 1, span("anchor_ts"), span("anchor_ts") + 1)))
    joined = bars.withColumn("_span", span("ts")).join(near, ["symbol", "_span"]).drop("_span")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("anchor_ts").cast("timestamp"))
    return joined.where(F.abs(gap) <= half)


def watchlist_scan(watchlist: DataFrame, bars: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """A row for each watched symbol with its last bar and studies, or an error. Symbols of bars are cut down first."""
    wanted = watchlist.select("symbol").distinct()
    out = watchlist.join(latest_bars(bars.join(wanted, "symbol", "left_semi")), "symbol", "left")
    out = out.withColumn("error", F.when(F.col("close").isNull(), F.lit("no bars")))
    return out if studies is None else out.join(studies, "symbol", "left")


def scan_grid(symbols: DataFrame, timeframes: list[str | None], results: DataFrame) -> DataFrame:
    """Every symbol with every time frame (null if none are given), success and error; results by symbol and resolution."""
    frames = F.explode(F.array(*(F.lit(t).cast("string") for t in (timeframes or [None]))))
    grid = symbols.select("symbol", frames.alias("resolution"))
    joined = grid.join(results.withColumn("_found", F.lit(True)), (grid["symbol"] == results["symbol"]) & grid["resolution"].eqNullSafe(results["resolution"]), "left")
    keep = [results[c] for c in results.columns if c not in KEY]
    return joined.select(grid["symbol"], grid["resolution"], *keep, F.coalesce("_found", F.lit(False)).alias("success"), F.when(F.col("_found").isNull(), "no data").alias("error"))


def batch_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total_iterations"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def order_fills(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """orders with filled_qty: of the first attempt with a positive fill, else 0."""
    first = fills.where("qty > 0").groupBy("order_id").agg(F.min_by("qty", "attempt").alias("filled_qty"))
    return orders.join(first, "order_id", "left").withColumn("filled_qty", F.coalesce("filled_qty", F.lit(0.0)))


def account_value(balances: DataFrame, prices: DataFrame) -> DataFrame:
    """account, total_value: cash plus quantity times price; coins without price or quantity count 0."""
    worth = balances.join(prices, "coin", "left").withColumn("_w", F.coalesce(F.col("qty") * F.coalesce("price", F.lit(0.0)), F.lit(0.0)))
    return worth.groupBy("account").agg(F.sum("_w").alias("total_value"))


def new_entities(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    return after.join(before.select(key), key, "left_anti")


def removed_entities(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    return before.join(after.select(key), key, "left_anti")


def nearest_level(quotes: DataFrame, levels: DataFrame) -> DataFrame:
    """quotes (symbol, last) with key_level, support (at or under), resistance (over); at a tie the higher level."""
    gap = F.abs(F.col("level") - F.col("last"))
    found = levels.join(quotes.select("symbol", "last"), "symbol").groupBy("symbol").agg(
        F.min_by("level", F.struct(gap.alias("g"), (-F.col("level")).alias("l"))).alias("key_level"),
        F.max(F.when(F.col("level") <= F.col("last"), F.col("level"))).alias("support"),
        F.min(F.when(F.col("level") > F.col("last"), F.col("level"))).alias("resistance"),
    )
    return quotes.join(found, "symbol", "left")


def zone_touch(bars: DataFrame, zones: DataFrame, step: float = 1.0) -> DataFrame:
    """Bars and zones (symbol, zone_high, zone_low) that overlap, each pair once.

    Two ranges overlap if one holds the other's low end. In steps of price, a range is cut into
    aligned pieces, 2 for each doubling of its width at most, and an end looks at the pieces of
    those levels that occur: equalities on symbol and piece, whatever the widths. The levels, 62
    at most, come to the driver. Ranges with a null, nan or infinite end, or a high end under the
    low one, overlap with nothing.
    """
    cut = lambda c: F.floor(F.col(c) / step)
    fine = lambda low, high: (F.col(low) <= F.col(high)) & (F.abs(low) < 1e15) & (F.abs(high) < 1e15)
    sides = {"bar": (bars.where(fine("low", "high")), "low", "high"), "zone": (zones.where(fine("zone_low", "zone_high")), "zone_low", "zone_high")}
    columns = [*bars.columns, *(c for c in zones.columns if c != "symbol")]
    out = None
    # The zone's low end inside the bar; then the bar's inside the zone, but for the zone's own low end.
    for holder, point in (("bar", "zone"), ("zone", "bar")):
        ranged, low, high = sides[holder]
        pointed, at, _ = sides[point]
        ranged = ranged.withColumn("_p", F.explode(pieces(cut(low), cut(high))))
        levels = sorted(r[0] for r in ranged.select("_p.level").distinct().collect())
        pointed = pointed.withColumn("_p", F.explode(pieces_of(cut(at), levels)))
        inside = (F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high)) if holder == "bar" else (F.col(low) < F.col(at)) & (F.col(at) <= F.col(high))
        found = ranged.join(pointed, ["symbol", "_p"]).where(inside).select(*columns)
        out = found if out is None else out.unionByName(found)
    return out


TREE_BITS, TREE_LEVELS = 4, 4  # nodes of 1, 16, 256 and 4096 spans


def _span_tree(bars: DataFrame, span_seconds: int) -> DataFrame:
    """symbol, level, piece and, over the node's bars: the extremes of closes, of closes and those before them, of closes that rose to or fell to theirs."""
    seen = places(bars, "close")
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / span_seconds)
    close, before = F.col("close"), F.col("_before")
    leaf = seen.groupBy("symbol", span.alias("piece")).agg(
        F.max("close").alias("top"), F.min("close").alias("bottom"),
        F.max(F.when(before.isNotNull(), F.greatest(close, before))).alias("all_top"), F.min(F.when(before.isNotNull(), F.least(close, before))).alias("all_bottom"),
        F.max(F.when(close > before, close)).alias("rose_to"), F.min(F.when(close < before, close)).alias("fell_to"),
    )
    highest, lowest = ("top", "all_top", "rose_to"), ("bottom", "all_bottom", "fell_to")
    out = level = leaf.withColumn("level", F.lit(0))
    for k in range(1, TREE_LEVELS):
        up = level.groupBy("symbol", piece_of(F.col("piece"), 1, TREE_BITS).alias("piece"))
        level = up.agg(*(F.max(c).alias(c) for c in highest), *(F.min(c).alias(c) for c in lowest)).withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out


def eval_alerts(bars: DataFrame, alerts: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """Active alerts with fired_ts: the first bar, from created to expiration, that meets the condition; null if none does.

    The bars of the spans in which an alert begins and ends are looked at one by one. Between
    them a tree over the spans tells by a node's extremes whether it has a bar that meets the
    condition: the lasting time is cut into the tree's nodes, the first that has one is followed
    down to its span, and only that span's bars are read. So rows grow with the alerts and the
    depth of the tree, not with the bars of the time that an alert lasts. An alert without an end
    lasts to its symbol's last bar. Nan closes meet nothing.
    """
    bars = bars.where("not isnan(close)")
    span = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / span_seconds)
    seen = places(bars, "close").select("symbol", "ts", "close", F.col("_before"), span("ts").alias("_span"))
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("_newest"))
    p, kind = F.col("price"), F.col("condition")
    crossed = ((F.col("_before") < p) & (F.col("close") >= p)) | ((F.col("_before") > p) & (F.col("close") <= p))
    meets = F.when(kind == "crossing", crossed).when(kind == "greater_than", F.col("close") > p).when(kind == "less_than", F.col("close") < p)
    # A path that rises to p or beyond and is below p at some time crosses it, before or after; so does one that falls to it.
    path = ((F.col("rose_to") >= p) & (F.col("all_bottom") < p)) | ((F.col("fell_to") <= p) & (F.col("all_top") > p))
    holds = F.when(kind == "crossing", path).when(kind == "greater_than", F.col("top") > p).when(kind == "less_than", F.col("bottom") < p)
    inside = (F.col("ts") >= F.col("created")) & (F.col("expiration").isNull() | (F.col("ts") <= F.col("expiration")))
    active = alerts.where("active")
    lasting = active.join(newest, "symbol").withColumn("_until", F.least("_newest", "expiration")).where(F.col("_until") >= F.col("created"))
    lasting = lasting.select("alert_id", "symbol", "price", "condition", "created", "expiration", span("created").alias("_first"), span("_until").alias("_last"))

    ends = lasting.withColumn("_span", F.explode(F.array_distinct(F.array("_first", "_last"))))
    tree = _span_tree(bars, span_seconds)
    nodes = tree.select(F.col("symbol").alias("_s"), F.col("level").alias("_l"), F.col("piece").alias("_p"), *(c for c in tree.columns if c not in ("symbol", "level", "piece")))
    cut = lasting.withColumn("_n", F.explode(pieces(F.col("_first") + 1, F.col("_last") - 1, TREE_BITS, TREE_LEVELS)))
    cut = cut.select("alert_id", "symbol", "price", "condition", "created", "expiration", F.col("_n.level").alias("_level"), F.col("_n.piece").alias("_piece"))
    keep = ["alert_id", "symbol", "price", "condition", "created", "expiration"]
    begins = F.col("_piece") * F.pow(F.lit(float(1 << TREE_BITS)), F.col("_level")).cast("long")
    met = cut.join(nodes, (F.col("symbol") == F.col("_s")) & (F.col("_level") == F.col("_l")) & (F.col("_piece") == F.col("_p"))).where(holds)
    at = met.groupBy("alert_id").agg(F.min_by(F.struct(*keep[1:], "_level", "_piece"), begins).alias("a")).select("alert_id", "a.*")
    for k in range(TREE_LEVELS - 1, 0, -1):
        here = at.where(F.col("_level") == k)
        below = nodes.where(F.col("_l") == k - 1).withColumn("_up", piece_of(F.col("_p"), 1, TREE_BITS))
        down = here.join(below, (F.col("symbol") == F.col("_s")) & (F.col("_piece") == F.col("_up"))).where(holds)
        down = down.groupBy("alert_id").agg(F.min_by(F.struct(*keep[1:], F.col("_l").alias("_level"), F.col("_p").alias("_piece")), "_p").alias("a")).select("alert_id", "a.*")
        at = at.where(F.col("_level") < k).unionByName(down)
    looked = ends.select(*keep, "_span").unionByName(at.select(*keep, F.col("_piece").alias("_span")))
    fired = looked.join(seen, ["symbol", "_span"]).where(meets & inside).groupBy("alert_id").agg(F.min("ts").alias("fired_ts"))
    return active.join(fired, "alert_id", "left")


def returns(bars: DataFrame) -> DataFrame:
    before = F.col("_before")
    return places(bars, "close").select(*KEY, "ts", F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0))).alias("ret")).where("ret is not null")


def pair_correlation(bars: DataFrame, least: int = 3, tile: int = 64, most_symbols: int = 4096, chunk: str = "month") -> DataFrame:
    """symbol_a, symbol_b, resolution, n, corr of simple returns at common times, for pairs with least of them; null without variance.

    Symbols are dealt to tiles of about ``tile``, times to chunks (a unit of date_trunc). A task has
    the returns of two tiles in one chunk as matrices, and their products are the sums of all its
    pairs; so rows grow with pairs times chunks, not times. Pairs grow with the square of the
    symbols: more than most_symbols raise, so bars must be of those compared (a watchlist).
    """
    symbols = bars.select("symbol").distinct().limit(most_symbols + 1).count()
    if symbols > most_symbols:
        raise ValueError(f"more than {most_symbols} symbols to compare")
    tiles = max(1, -(-symbols // tile))
    rows = returns(bars).where("not isnan(ret)").withColumns({"_tile": F.pmod(F.xxhash64("symbol"), F.lit(tiles)), "_chunk": F.date_trunc(chunk, "ts")})
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    rows = rows.select("resolution", "_chunk", F.least("_tile", "_other").alias("_low"), F.greatest("_tile", "_other").alias("_high"), "_tile", "symbol", "ts", "ret")
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["_low"].iloc[0], pdf["_high"].iloc[0]
        wide = pdf.pivot_table(index="ts", columns="symbol", values="ret", aggfunc="first")
        tile_of = pdf.groupby("symbol")["_tile"].first()
        sides = []
        for t in (low, high):
            names = [s for s in wide.columns if tile_of[s] == t]
            x = wide[names].to_numpy(float)
            there = ~np.isnan(x)
            sides.append((names, np.where(there, x, 0.0), there.astype(float)))
        (a, x, p), (b, y, q) = sides
        found = dict(zip(sums, (p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y), strict=True))
        k, m = np.nonzero(found["n"])
        first, second = np.array(a, object)[k], np.array(b, object)[m]
        keep = first < second if low == high else np.ones(len(k), bool)
        turned = first > second  # pairs are named in order
        out = {"symbol_a": np.where(turned, second, first), "symbol_b": np.where(turned, first, second), "resolution": pdf["resolution"].iloc[0]}
        for name in sums:
            swapped = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}.get(name, name)
            out[name] = np.where(turned, found[swapped][k, m], found[name][k, m])
        return pd.DataFrame(out)[keep]

    kinds = ", ".join(f"{name} double" for name in sums)
    each = rows.groupBy("resolution", "_chunk", "_low", "_high").applyInPandas(products, f"symbol_a string, symbol_b string, resolution string, {kinds}")
    total = each.groupBy("symbol_a", "symbol_b", "resolution").agg(*(F.sum(name).alias(name) for name in sums)).where(F.col("n") >= least)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    corr = F.when((vx > 0) & (vy > 0), F.try_divide(n * F.col("sxy") - sx * sy, F.sqrt(vx) * F.sqrt(vy)))
    return total.select("symbol_a", "symbol_b", "resolution", n.cast("long").alias("n"), F.when(corr.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))).alias("corr"))


def relative_strength(bars: DataFrame, n: int = 20) -> DataFrame:
    """Return over the last n times that all symbols of a resolution have, ranked from the strongest."""
    per = Window.partitionBy("resolution")
    symbols = bars.groupBy("resolution").agg(F.count_distinct("symbol").alias("_symbols"))
    common = bars.groupBy("resolution", "ts").agg(F.count_distinct("symbol").alias("_here")).join(symbols, "resolution").where("_here = _symbols")
    newest = common.withColumn("_r", F.row_number().over(per.orderBy(F.desc("ts")))).where(F.col("_r") <= n).select("resolution", "ts")
    ends = bars.join(newest, ["resolution", "ts"]).groupBy(*KEY).agg(F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"))
    out = ends.withColumn("ret", F.try_divide(F.col("last_close") - F.col("first_close"), F.nullif("first_close", F.lit(0.0))))
    return out.withColumn("rank", F.rank().over(per.orderBy(F.desc_nulls_last("ret"))))


def watchlist_add(watchlist: DataFrame, new: DataFrame) -> DataFrame:
    """watchlist and those new symbols that it lacks."""
    return watchlist.unionByName(new.distinct().join(watchlist.select("symbol"), "symbol", "left_anti"), allowMissingColumns=True)
