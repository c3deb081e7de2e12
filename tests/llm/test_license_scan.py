"""License scans against counting every window, and edge cases."""

import random

import pytest

from marketspark.llm import license_scan as scan


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates, percent):
    out = []
    for doc_id, text in rows:
        g = grams(words(text))
        for name, template in templates.items():
            t = set(grams(words(template)))
            half = 1
            while half < len(t):
                half *= 2
            best = max(((len(t & set(g[w : w + 2 * half])), -w) for w in range(0, len(g), half)), default=(0, 0))
            if g and 100 * best[0] >= percent * len(t):
                out.append((doc_id, name, best[0], len(t), -best[1]))
    return out


def test_same_as_counting_every_window(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        text = " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 3, 30, 300]))).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = rng.choice(list(scan.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        rows.append((k, rng.choice([" ", "\n", " - "]).join(text)))
    got = scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows, scan.TEMPLATES, 80)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nulls_empty_long_and_repeated_rows(spark):
    long = "x " * 50_000 + "released UNDER the MIT license, " + "y " * 50_000
    rows = [(1, None), (2, ""), (3, long), (None, "Released under the MIT License"), (4, "Released under the"), (4, "é" * 10_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows + rows[3:4]], "doc_id long, text string, start int")
    assert sorted(str(r["doc_id"]) for r in scan.scan(df).collect()) == ["3", "None", "None"]
    assert scan.scan(df.limit(0)).count() == 0


def test_bad_templates(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        scan.scan(df, {"short": "two words"})
