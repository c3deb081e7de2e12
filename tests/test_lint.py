"""The lint of scripts against a walk over each script's lines, and its plan."""

import random
import re

from marketspark.operators import lint as L

PIECES = [
    "a = array.from()", "a = array.from(1, 2)", "b = array.new_float(0)", "b = array.new<int>(3)", "b = array.new<int>(n)", "var a = array.from(f(1), 2)",
    "x = array.get(a, 1)", "array.set(b, 7, 1.0) + array.get( a ,-2)", "array.get(c, 1)", "y = a.first() + b.last()", "array.first() - b.first()", "z = a.last() + array.get(b, 3)",
    'strategy("s")', '  strategy("s")', 'x = strategy("s")', "strategy.entry(1)", "\tstrategy.close(1)", "//@version=4", "//@version=6", "// note", "", "//@version=", "plot(close)",
]


def walked(source):
    """Diagnostics by a plain walk, as (severity, line, column, message)."""
    lines, sizes, out = source.split("\n"), {}, []
    for text in lines:
        listed, made = re.search(L.DECLARED_FROM, text), re.search(L.DECLARED_NEW, text)
        if listed:
            sizes[listed[1]] = len(listed[2].split(",")) if listed[2].strip() else 0
        elif made:
            sizes[made[1]] = int(made[2]) if made[2] else None
    for n, text in enumerate(lines, 1):
        for m in re.finditer(L.ACCESS, text):
            size, i = sizes.get(m[2]), int(m[3])
            if size is not None and not 0 <= i < size:
                out.append(("error", n, m.start() + 1, L.BEYOND_SIZE % (m[1], m[2], i, i, size)))
        for m in re.finditer(L.ENDS, text):
            if m[1] != "array" and sizes.get(m[1]) == 0:
                out.append(("warning", n, m.start() + 1, L.MAYBE_EMPTY % (m[1], m[2])))
    if not any(t.strip().startswith("strategy(") for t in lines):
        out += [("error", n, 1, L.NO_STRATEGY) for n, t in enumerate(lines, 1) if "strategy.entry" in t or "strategy.close" in t][:1]
    stop = next((t.strip() for t in lines if t.strip().startswith("//@version=") or (t.strip() and not t.strip().startswith("//"))), "")
    version = re.search(L.VERSION, source)
    if version and int(version[1]) < 5 and not stop.startswith("//@version=6"):
        out.append(("info", 1, 1, L.OLD_VERSION % version[1]))
    return sorted(out)


def test_lint_is_the_walk(spark):
    rng = random.Random(5)
    sources = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(600)] + [None, "", "\n", sum_of_accesses()]
    found = {}
    # Columns of the same names as the lint's own, and two scripts with one id, change nothing.
    df = spark.createDataFrame([(k, s, "x", 1) for k, s in enumerate(sources)], "script_id int, source string, text string, line int")
    for r in L.script_lint(df).collect():
        found.setdefault(r["script_id"], []).append((r["severity"], r["line"], r["column"], r["message"]))
    assert sum(map(len, found.values())) > 500
    for k, source in enumerate(sources):
        assert sorted(found.get(k, [])) == (walked(source) if source is not None else []), source
    twice = L.script_lint(df.unionByName(df))
    assert twice.count() == 2 * sum(map(len, found.values()))
    assert L.script_lint(df.limit(0)).count() == 0


def sum_of_accesses():
    """One long line with many matches."""
    return "a = array.from(1)\nx = " + " + ".join(f"array.get(a, {k}) + a.first()" for k in range(300))


def test_one_scan_without_joins(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "script_id int, source string").write.parquet(f"{tmp_path}/s")
    plan = L.script_lint(spark.read.parquet(f"{tmp_path}/s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan and "Window" not in plan
