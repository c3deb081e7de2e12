"""Static checks over a corpus of scripts, line by line."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How scripts declare and use arrays, and what is said of them.
DECLARED_FROM = r"(\w+)\s*=\s*array\.from\(([^)]*)\)"
DECLARED_NEW = r"(\w+)\s*=\s*array\.new(?:<\w+>|_\w+)\(([0-9]+)?"
ACCESS = r"array\.(get|set)\(\s*(\w+)\s*,\s*(-?[0-9]+)"
ENDS = r"(\w+)\.(first|last)\(\)"
VERSION = r"//@version=([0-9]+)"
BEYOND_SIZE = "array.%s(%s, %s) — index %s out of bounds (array size is %s)"
MAYBE_EMPTY = "%s.%s() called on possibly empty array (declared with size 0)"
NO_STRATEGY = "strategy.entry/close used but no strategy() declaration found — did you mean to use indicator()?"
OLD_VERSION = "Script uses Pine v%s — consider upgrading to v6 for latest features"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")


def declared_arrays(lines: Column) -> Column:
    """Arrays that the lines declare, as struct(name, size), the last declaration first; a size that isn't written out is null."""

    def declared(text: Column) -> Column:
        listed = F.trim(F.regexp_extract(text, DECLARED_FROM, 2))
        from_list = F.struct(F.regexp_extract(text, DECLARED_FROM, 1).alias("name"), F.when(listed == "", 0).otherwise(F.size(F.split(listed, ","))).alias("size"))
        by_size = F.struct(F.regexp_extract(text, DECLARED_NEW, 1).alias("name"), F.regexp_extract(text, DECLARED_NEW, 2).try_cast("int").alias("size"))
        return F.when(text.contains("array.from(") & text.rlike(DECLARED_FROM), from_list).when(text.contains("array.new") & text.rlike(DECLARED_NEW), by_size)

    candidates = F.filter(lines, lambda t: t.contains("array.from(") | t.contains("array.new"))  # cheaper than the patterns
    return F.reverse(F.filter(F.transform(candidates, declared), lambda d: d.isNotNull()))


def _found(kind: str, groups: int) -> Column:
    """struct(kind, column, g1, g2, g3) of a line's matches; between them is what splitting at them leaves."""
    matches, between = f"_{kind}_0", f"_{kind}_between"

    def length(parts: str, n: Column) -> Column:
        return F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))

    def one(_: Column, k: Column) -> Column:
        texts = [F.get(f"_{kind}_{g}", k) if g <= groups else F.lit(None).cast("string") for g in (1, 2, 3)]
        column = length(between, k + 1) + length(matches, k) + 1
        return F.struct(F.lit(kind).alias("kind"), column.alias("column"), *(t.alias(f"g{g}") for g, t in enumerate(texts, 1)))

    return F.transform(matches, one)


def _one(kind: str, text: Column, wanted: Column) -> Column:
    """The same struct for a whole line, where it is wanted."""
    none = F.lit(None).cast("string")
    return F.filter(F.array(F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("column"), text.alias("g1"), none.alias("g2"), none.alias("g3"))), lambda _: wanted)


def script_lint(scripts: DataFrame) -> DataFrame:
    """script_id, line, column, message, severity.

    Literal indexes beyond an array's size, first() or last() of arrays declared empty, orders
    in scripts without a strategy declaration (the first only), and versions before 5. A later
    declaration of a name replaces an earlier one. A null source has no diagnostics.

    One pass: a script's facts (arrays, first order, version) are columns beside its lines, and
    only lines that can have a diagnostic become rows.
    """
    split = scripts.select("script_id", F.regexp_extract("source", VERSION, 1).alias("_version"), F.split("source", "\n").alias("_lines"))
    lines = split.select("*", F.transform("_lines", _trimmed).alias("_trim"))
    numbered = F.transform("_lines", lambda t, k: F.struct((k + 1).alias("line"), t.alias("text")))
    # The first line that is neither empty nor a plain comment decides, as does the first version line.
    decides = F.get(F.filter("_trim", lambda t: t.startswith("//@version=") | ((t != "") & ~t.startswith("//"))), 0)
    order = F.get(F.filter(numbered, lambda x: x["text"].contains("strategy.entry") | x["text"].contains("strategy.close")), 0)["line"]
    facts = lines.select(
        "script_id",
        numbered.alias("_lines"),
        declared_arrays(F.col("_lines")).alias("_arrays"),
        F.when(~F.exists("_trim", lambda t: t.startswith("strategy(")), order).alias("_order"),
        F.when((F.col("_version").try_cast("int") < 5) & ~F.coalesce(decides.startswith("//@version=6"), F.lit(False)), F.col("_version")).alias("_old"),
    )
    old, first_order = lambda line: (line == 1) & F.col("_old").isNotNull(), lambda line: F.coalesce(line == F.col("_order"), F.lit(False))
    kinds = {"access": (ACCESS, 3, ("array.get(", "array.set(")), "ends": (ENDS, 2, (".first()", ".last()"))}  # pattern, groups, and texts of which a match has one
    holds = lambda text, words: functools.reduce(Column.__or__, (text.contains(w) for w in words))
    some = F.filter("_lines", lambda x: holds(x["text"], [w for _, _, words in kinds.values() for w in words]) | old(x["line"]) | first_order(x["line"]))
    # inline_outer: of inline Spark would infer a filter and evaluate all of this once more below it.
    rows = facts.select("script_id", "_arrays", "_order", "_old", F.inline_outer(some)).where("line is not null")
    nothing = F.array().cast("array<string>")
    matched = rows.select(
        "*",
        *(F.when(holds(F.col("text"), words), F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(g + 1))).otherwise(nothing).alias(f"_{kind}_{g}") for kind, (p, n, words) in kinds.items() for g in range(n + 1)),
        *(F.when(holds(F.col("text"), words), F.split("text", p)).otherwise(nothing).alias(f"_{kind}_between") for kind, (p, _, words) in kinds.items()),
    )
    found = F.concat(
        *(_found(kind, n) for kind, (_, n, _) in kinds.items()),
        _one("order", F.lit(""), first_order(F.col("line"))),
        _one("old", F.coalesce("_old", F.lit("")), old(F.col("line"))),
    )
    at = matched.select("script_id", "line", "_arrays", F.inline_outer(found)).where("kind is not null")

    is_a = lambda kind: F.col("kind") == kind
    name = F.when(is_a("access"), F.col("g2")).when(is_a("ends"), F.col("g1"))
    sized = at.withColumn("size", F.get(F.filter("_arrays", lambda a: a["name"] == name), 0)["size"])
    index = F.col("g3").try_cast("decimal(38,0)")  # longer literals than decimals hold are beyond any size
    shown = F.coalesce(index.cast("string"), F.col("g3"))
    beyond = F.col("size").isNotNull() & (index.isNull() | (index < 0) | (index >= F.col("size")))
    empty = (F.col("g1") != "array") & (F.col("size") == 0)
    faulty = sized.where(F.when(is_a("access"), beyond).when(is_a("ends"), empty).otherwise(True))
    message = (
        F.when(is_a("access"), F.format_string(BEYOND_SIZE, "g1", "g2", shown, shown, "size"))
        .when(is_a("ends"), F.format_string(MAYBE_EMPTY, "g1", "g2"))
        .when(is_a("order"), NO_STRATEGY)
        .otherwise(F.format_string(OLD_VERSION, "g1"))
    )
    severity = F.when(is_a("ends"), "warning").when(is_a("old"), "info").otherwise("error")
    return faulty.select("script_id", F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), message.alias("message"), severity.alias("severity"))


def flatten_compile_report(reports: DataFrame, report: str = "report") -> DataFrame:
    """script_id, kind (error or warning), line, column, end_line, end_column, message of compiler reports.

    A script without rows of kind error has compiled.
    """
    place = "struct<line:int,column:int>"
    entry = f"array<struct<start:{place},`end`:{place},message:string>>"
    parsed = reports.select("script_id", F.from_json(report, f"result struct<errors2:{entry},warnings2:{entry}>").alias("j"), F.get_json_object(report, "$.error").alias("top"))

    def rows(entries: str, kind: str) -> DataFrame:
        e = parsed.select("script_id", F.explode(f"j.result.{entries}").alias("e"))
        ends = (F.col("e.end.line"), F.col("e.end.column")) if kind == "error" else (F.lit(None).cast("int"), F.lit(None).cast("int"))
        return e.select("script_id", F.lit(kind).alias("kind"), F.col("e.start.line").alias("line"), F.col("e.start.column").alias("column"), ends[0].alias("end_line"), ends[1].alias("end_column"), F.col("e.message").alias("message"))

    none = F.lit(None).cast("int")
    # Only a text counts as an error of its own, not an object.
    top = parsed.where(F.col("top").isNotNull() & ~F.coalesce(F.col("top"), F.lit("")).rlike(r"^[{\[]"))
    top = top.select("script_id", F.lit("error").alias("kind"), none.alias("line"), none.alias("column"), none.alias("end_line"), none.alias("end_column"), F.col("top").alias("message"))
    return rows("errors2", "error").unionByName(rows("warnings2", "warning")).unionByName(top)


def compile_counts(reports: DataFrame, report: str = "report") -> DataFrame:
    """script_id, compiled, error_count, warning_count of every report."""
    flat = flatten_compile_report(reports, report).groupBy("script_id").agg(F.count_if(F.col("kind") == "error").alias("error_count"), F.count_if(F.col("kind") == "warning").alias("warning_count"))
    joined = reports.select("script_id").join(flat, "script_id", "left")
    zero = F.lit(0).cast("long")
    out = joined.select("script_id", F.coalesce("error_count", zero).alias("error_count"), F.coalesce("warning_count", zero).alias("warning_count"))
    return out.withColumn("compiled", F.col("error_count") == 0)

