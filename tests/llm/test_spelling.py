"""Spelling variants against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from marketspark.llm import queries, spelling


def one_edit(a, b):
    """Whether a and b differ by one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_words(rows, least=3):
    """n of each word, run by run."""
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if n >= least and len(w) >= 5}


def brute_groups(words, near):
    """word, form, root, n, n_near, form_n by looking at every pair."""
    form = {}
    for w, n in words.items():
        v = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = v if v is not None and words[v] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def all_pairs(words):
    return {w: [v for v in words if one_edit(w, v)] for w in words}


def plain(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def made(n, seed, letters="aabé", longest=9):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        out["".join(rng.choice(letters) for _ in range(rng.randrange(5, longest + 1)))] = rng.choice([3, 4, 7, 8, 16, 40, 90])
    return out


def test_search_finds_each_pair_once():
    words = sorted(made(400, 1)) + ["banana", "banaana", "bananaa", "xbanana", "zzzzz", "zzzzzz"]
    found = Counter()
    for forward in (True, False):
        for query, target in spelling.near_words(words, words, forward):
            found.update((words[q], words[t]) for q, t in zip(query.tolist(), target.tolist(), strict=True))
    assert set(found.values()) == {1}
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}


@pytest.mark.parametrize("index_words", [16384, 60, 7])
def test_same_as_all_pairs(spark, index_words):
    words = made(500, 2) | {"a" * k: 3 * 2**k for k in range(5, 14)} | {"×÷ÿÀÀ": 5, "×÷ÿÀ": 5} | made(60, 3, "xyzuvw", 24)
    words = {w: n for w, n in words.items() if len(w) >= 5}
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, half int").repartition(3)
    want = brute_groups(words, all_pairs(words))
    assert sum(1 for r in want if r[1]) > 100 and max(r[4] for r in want) > 8 and any(r[2] not in (r[0], r[1]) for r in want)
    assert plain(spelling.variant_groups(df, index_words)) == want


def test_runs_across_chunks(monkeypatch):
    rng = random.Random(4)
    for size in (2, 3, 7, 50):
        monkeypatch.setattr(spelling, "CHUNK", size)
        for _ in range(60):
            text = "".join(rng.choice(["ab", "é", "ß", " ", "Ā", "-", "c", "ÿÃ"]) for _ in range(rng.randrange(40))).encode()
            assert spelling.runs_of(text) == Counter(spelling.RUN.findall(text))


def test_odd_texts(spark):
    long = "Straßen-häuser " * 200_000
    rows = [(1, None), (2, ""), (None, "Lantern lantern LANTERN lanterns"), (3, long), (4, "lantern Étage étage Étage Étage Łódź"), (4, "lantern Étage étage Étage Étage Łódź"), (5, "abcd abcd abcd abcd")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n int")
    want = brute_words(rows)
    assert {"lantern", "Étage"} <= set(want) and want["straßen"] == 200_000
    words = spelling.vocabulary(df)
    assert dict(map(tuple, words.collect())) == want
    assert plain(spelling.variant_groups(words)) == brute_groups(want, all_pairs(want))


def test_short_words_and_empty_tables(spark):
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([("four", 3)], "word string, n long"))
    assert spelling.variant_groups(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    words = brute_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    # Two words one edit apart have a common form with one code point out, or one less.
    short = {}
    for w in words:
        for form in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            short.setdefault(form, []).append(w)
    near = {w: [v for v in {v for form in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for v in short[form]} if one_edit(w, v)] for w in words}
    assert plain(queries.op13_spelling_variants(spark, sf_dir)) == brute_groups(words, near)
