"""Scalar functions. Where numbers are rounded or tested for truth, they follow JavaScript's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 0) -> Column:
    """x rounded half up, towards plus infinity, in binary floating point. NaN and infinities stay, as do doubles without a fraction."""
    scale = float(10**digits)
    scaled = x * scale
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled + 0.5) / F.lit(scale)).otherwise(scaled / F.lit(scale))


def or_zero(x: Column) -> Column:
    """0.0 for null and NaN."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def or_null(x: Column) -> Column:
    """null for 0 and NaN."""
    return F.nullif(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def number_text(x: Column) -> Column:
    """A number of two decimals at most, without trailing zeros."""
    fixed = x.cast("decimal(38,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def pct_text(x: Column) -> Column:
    """x rounded to two decimals, with a percent sign."""
    return F.concat(number_text(js_round(x, 2)), F.lit("%"))


def parse_price(text: Column) -> Column:
    """The number that begins what digits, dots and minus signs are left of the text; null if none does."""
    left = F.regexp_replace(text, r"[^0-9.\-]", "")  # a fixed value, as the number's form below
    return F.regexp_extract(left, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


def strip_em(text: Column) -> Column:
    """The text without <em> and </em>; '' for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "</?em>", "")


def numeric_cells(cells: Column) -> Column:
    """Those texts of an array that are signed numbers, with or without commas and a percent sign."""
    # A fixed value: the form of a number in a cell.
    return F.filter(cells, lambda c: F.regexp_replace(c, r"[\s,]", "").rlike(r"^[+\-]?[0-9]+\.?[0-9]*%?$"))


def watch_values(cells: Column) -> Column:
    """struct(last, change, change_percent): the first three numeric cells, as text."""
    found = numeric_cells(cells)
    return F.struct(F.get(found, 0).alias("last"), F.get(found, 1).alias("change"), F.get(found, 2).alias("change_percent"))


def is_ticker(text: Column) -> Column:
    # A fixed value: the form of a ticker.
    return text.rlike(r"^[A-Z][A-Z0-9.:!]{0,20}$")


def alert_symbol(text: Column) -> Column:
    """The symbol of ={"symbol": ...}; any other text as it is."""
    return F.coalesce(F.nullif(F.get_json_object(F.regexp_replace(text, "^=", ""), "$.symbol"), F.lit("")), text)


def to_epoch(text: Column, strict: bool = False) -> Column:
    """Seconds since 1970 of a text of digits or an ISO date or time; what is neither is null, or an error if strict."""
    found = F.when(text.rlike(r"^[0-9]+$"), text.try_cast("long")).otherwise(F.unix_seconds(text.try_cast("timestamp")))
    return F.when(text.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("not a date: "), text)).cast("long")).otherwise(found) if strict else found


def date_key(ts: Column) -> Column:
    """YYYY-MM-DD in the session's time zone, which is UTC."""
    return F.date_format(ts, "yyyy-MM-dd")


def resolution_seconds(code: Column) -> Column:
    """Seconds of a bar: D, W and M with or without 1, else minutes. Other codes raise."""
    minutes = F.regexp_extract(code, r"^\s*([0-9]+)\s*$", 1).try_cast("long")
    return (
        F.when(code.isin("D", "1D"), F.lit(86_400))
        .when(code.isin("W", "1W"), F.lit(604_800))
        .when(code.isin("M", "1M"), F.lit(2_592_000))
        .when(minutes > 0, minutes * 60)
        .otherwise(F.raise_error(F.concat(F.lit("unknown resolution: "), F.coalesce(code, F.lit("null")))).cast("long"))
    )


def brief_line(symbol: Column, bias: Column, level: Column, watch: Column) -> Column:
    """SYMBOL | BIAS: x | KEY LEVEL: p | WATCH: t."""
    return F.concat(symbol, F.lit(" | BIAS: "), bias, F.lit(" | KEY LEVEL: "), F.coalesce(level, F.lit("-")), F.lit(" | WATCH: "), watch)


def classify_console(line: Column, css_class: Column) -> Column:
    """struct(timestamp, type): a leading time, and error, compile, warning or info."""
    # The form of a time, the words looked for and how far from the line's start.
    stamp = F.regexp_extract(line, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}\s+)?[0-9]{2}:[0-9]{2}:[0-9]{2}", 0)
    kind = F.coalesce(css_class, F.lit(""))
    found = (
        F.when(kind.rlike("(?i)error") | F.substring(line, 1, 30).rlike("(?i)error"), F.lit("error"))
        .when(F.substring(line, 1, 40).rlike("(?i)compil"), F.lit("compile"))
        .when(kind.rlike("(?i)warn"), F.lit("warning"))
        .otherwise(F.lit("info"))
    )
    return F.struct(F.nullif(stamp, F.lit("")).alias("timestamp"), found.alias("type"))
