"""URL filters: a trie over reversed host labels and path segments, longest match wins.

A rule is (action, host, path). It fits its host and all subdomains, if the url's path
starts with the rule's path, compared as strings. Of several fitting rules the one with
the longest host and path together decides; at equal length the longer host, then block.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_names

ACTIONS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "rule string, action string"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or without :// gives ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; null or without :// gives ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_rows(rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Checked rules, one for each host and path: block goes before allow. Raises ValueError on others."""
    kept: dict[tuple[str, str], str] = {}
    for action, host, path in rules:
        if action not in ACTIONS or not host:
            raise ValueError(f"a rule is (allow or block, host, path), not {(action, host, path)}")
        key = (host.translate(str.maketrans(UPPER, LOWER)), path)
        kept[key] = max(action, kept.get(key, action))
    return [(action, host, path) for (host, path), action in sorted(kept.items())]


class Trie:
    """Nodes of host labels from the right; at a host's node, nodes of path segments that end in /.

    What follows the last / of a rule's path is kept beside its node and compared as a prefix.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rule_rows(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *segments, tail = path.split("/")
            node = node.setdefault(("paths",), {})
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(("tails",), {})[tail] = (len(host) + len(path), len(host), action, host + path)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule and action of the longest match, or None and None."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if ("paths",) in node:
                best = self._deepest(node["paths",], segments, best)
        return (best[3], best[2]) if best else (None, None)

    @staticmethod
    def _deepest(node: dict, segments: list[str], best):
        for k, segment in enumerate(segments):
            for tail, found in node.get(("tails",), {}).items():
                if segment.startswith(tail) and (best is None or found > best):
                    best = found
            if k == len(segments) - 1 or segment not in node:
                break
            node = node[segment]
        return best


def filter_urls(
    df: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    url: str = "url",
    default: str = "allow",
    most_rules: int = 200_000,
) -> DataFrame:
    """df with host, path, rule and verdict.

    rule is the deciding rule's host and path, null if none fits; verdict is allow or
    block. Null urls and urls without :// have empty host and path and get the default.
    Columns of df with one of these names are replaced; all others stay, whatever their names.
    Urls of any length are judged whole, repeated rows each, and an empty df gives no rows. The
    trie is broadcast up to most_rules rules; a larger list is joined instead, which gives the
    same rows.
    """
    rules = rule_rows(rules)
    base = df.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(df[url]), "path": url_path(df[url])})
    action, found = new_names(base, "action", "found")
    judged = _with_trie(base, rules, action, found) if len(rules) <= most_rules else _with_join(base, rules, action, found)
    return judged.withColumn("verdict", F.coalesce(action, F.lit(default))).drop(action)


def _with_trie(base: DataFrame, rules: list[tuple[str, str, str]], action: str, found: str) -> DataFrame:
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast(rules)
    built: list[Trie] = []

    @F.pandas_udf(VERDICT)
    def judge(host, path):
        import pandas as pd

        if not built:
            built.append(Trie(shared.value))
        return pd.DataFrame([built[0].match(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "action"])

    return base.withColumn(found, judge("host", "path")).withColumns({"rule": F.col(f"{found}.rule"), action: F.col(f"{found}.action")}).drop(found)


def _with_join(base: DataFrame, rules: list[tuple[str, str, str]], action: str, found: str) -> DataFrame:
    """Each distinct host and path meets the rules of its host's suffixes; the longest that fits is kept."""
    spark = base.sparkSession
    table = spark.createDataFrame(rules, "action string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = base.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = keys.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    length = F.length("rule_host") + F.length("rule_path")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(length.alias("n"), F.length("rule_host").alias("h"), "action", F.concat("rule_host", "rule_path").alias("rule"))).alias(found)
    )
    return base.join(best, ["host", "path"], "left").select(
        *(base[c] for c in base.columns), F.col(f"{found}.rule").alias("rule"), F.col(f"{found}.action").alias(action)
    )

