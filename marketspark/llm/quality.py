"""Quality rules: a ledger of failure bits, to which versioned policies are applied.

Every rule is evaluated once over whole texts. The ledger keeps, for each document, the
measurements and one long whose bit k says that the document fails rule k. A policy is
a named set of rules; applying it and asking what would change without a rule (an
ablation) are bitwise operations on the ledger, so no text is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Lines with a word, for later rules; not among MEASURES, which op6 gives out.
MORE_MEASURES = (*MEASURES, "n_lines")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """A document fails where fails(measures) is true; a null counts as not failed."""

    bit: int
    name: str
    fails: Callable[[], Column]


def _share(part: str, whole: str, percent: int) -> Column:
    return 100 * F.col(part) > percent * F.col(whole)


#: The bits never change meaning; a new threshold is a new bit. Thresholds: the usual published
#: web-text heuristics (mean word length 3 to 10, symbols, repeated lines), all in whole numbers.
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_windows", lambda: _share("n_repeat_words", "n_words", 50)),
    Rule(2, "short_words", lambda: F.col("word_chars") < 3 * F.col("n_words")),
    Rule(3, "long_words", lambda: F.col("word_chars") > 10 * F.col("n_words")),
    Rule(4, "symbols", lambda: _share("n_symbols", "n_words", 10)),
    Rule(5, "repeated_lines", lambda: F.col("n_dup_lines") > 3),
    Rule(6, "many_words", lambda: F.col("n_words") > 100_000),
    Rule(7, "hardly_any_words", lambda: F.col("n_words") < 3),
    Rule(8, "repeated_windows_of_many", lambda: (F.col("n_words") >= 50) & _share("n_repeat_words", "n_words", 50)),
    # A share alone would reject clean texts of a few lines of which two are equal.
    Rule(9, "repeated_line_share", lambda: (F.col("n_dup_lines") > 3) & _share("n_dup_lines", "n_lines", 30)),
)
#: The rules whose bits op6 gives out; its SQL has these.
FIRST_RULES = RULES[:9]
#: Version to the rules that reject; a version is never edited, only added to.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "many_words"),
    # Short texts may be clean: this one rejects junk of any length, and nothing for being short.
    # Nor for being long: repeated lines count by their share.
    "corpus": ("hardly_any_words", "repeated_windows_of_many", "symbols", "repeated_line_share"),
}
#: v1 without rejecting texts for their length alone; for apply_policy's policies.
LATER_POLICIES = {"v2": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_line_share")}


def mask_of(names, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def _repeats(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    most = int(ids.max()) + 1
    if most**3 < 1 << 62:
        keys = (ids[:-2] * most + ids[1:-1]) * most + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * most + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        keys = np.unique(pairs, return_inverse=True)[1].astype(np.int64) * most + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(column: pa.Array) -> list[np.ndarray]:
    """MORE_MEASURES of each text."""
    rows = len(column)
    out = [np.zeros(rows, np.int64) for _ in MORE_MEASURES]
    for b in W.blocks(column):
        span = slice(b.first, b.last)
        counts = b.counts()
        out[0][span] = counts
        chars = np.concatenate([[0], np.cumsum(~W.WHITE[b.data] & ((b.data & 0xC0) != 0x80))])
        out[1][span] = chars[b.offsets[1:]] - chars[b.offsets[:-1]]
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[b.data])])
        out[2][span] = symbols[b.offsets[1:]] - symbols[b.offsets[:-1]]
        raw = b.data.tobytes()
        out[5][span] = counts > 0  # texts of one word
        for k in np.flatnonzero(counts > 1).tolist():
            text = raw[b.offsets[k] : b.offsets[k + 1]]
            lines = [x for x in text.split(b"\n") if x.strip()]
            out[3][b.first + k] = len(lines) - len(set(lines))
            out[5][b.first + k] = len(lines)
            if counts[k] > 3:
                ids: dict[bytes, int] = {}
                found = [ids.setdefault(w, len(ids)) for w in text.split()]
                out[4][b.first + k] = _repeats(np.array(found, np.int64))
    return out


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """df without its text (but for keep_text), with MORE_MEASURES (long) and fail_bits (long).

    Null and empty texts have no words, so all measures are 0. Columns of df with these
    names are replaced. No shuffle; memory follows the longest text. Rows stay rows:
    repeated rows are each judged.
    """
    names = [*MORE_MEASURES, "fail_bits"]
    keep = [c for c in df.columns if c not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], *map(pa.array, found)], [*held, *MORE_MEASURES])

    held = [*keep, text] if keep_text else keep
    schema = T.StructType([*df.select(*held).schema, *(T.StructField(m, T.LongType()) for m in MORE_MEASURES)])
    measured = df.select(*keep, F.col(text)).mapInArrow(W.lean(run), schema)
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, version: str = "v1", policies=POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with kept: true where no rule of the policy has failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policies[version], rules)).cast("long")) == 0)


def ablations(entries: DataFrame, version: str = "v1", policies=POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rule, failed (documents), only_by (rejected by it alone), kept_without.

    Documents are first counted by their failure bits, so what is combined has at most
    two to the power of the number of rules rows.
    """
    mask = mask_of(policies[version], rules)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in rules if mask >> r.bit & 1]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen)))
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    zero = F.lit(0).cast("long")
    return (
        patterns.select("bits", "n", each.alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            F.sum(F.when(fails, F.col("n")).otherwise(zero)).alias("failed"),
            F.sum(F.when(fails & (rest == 0), F.col("n")).otherwise(zero)).alias("only_by"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(zero)).alias("kept_without"),
        )
    )


def quality_filter(df: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """Rows of df that the policy keeps, with df's columns only; columns named like measures survive.

    The text rides along through the measuring tasks, so filtering needs no join.
    """
    other = {c: f"_own_{k}" for k, c in enumerate(df.columns) if c != text}
    renamed = df.select(*(F.col(c).alias(other.get(c, c)) for c in df.columns))
    kept = apply_policy(ledger(renamed, text, keep_text=True), version).where("kept")
    return kept.select(*(F.col(other.get(c, c)).alias(c) for c in df.columns))
