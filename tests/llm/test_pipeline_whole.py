"""Every stage of the pipeline, and run(), against brute force on one made corpus; odd rows and names."""

import random
import zlib

import corpus_pipeline
import numpy as np
from marketspark.llm import mixing, packing
from tokenizers import Tokenizer

from marketspark.llm import encode

from .test_jaccard import brute as groups_of
from .test_mixing import shared_out

#: Extra columns with names that operators use inside.
EXTRA = ["row_id", "uid", "at", "epoch", "parts", "tok", "fail_bits", "kept", "grp", "n_words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA)


def made():
    """Clean texts, near and exact copies, a shared passage, junk, empty ones, repeated rows, a hot source and a null one."""
    rng = random.Random(21)
    words = [f"word{k}" for k in range(4000)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = []
    for k in range(90):
        text = [rng.choice(words) for _ in range(rng.choice([12, 60, 200, 700, 1500]))]
        if k % 9 == 0:
            text[len(text) // 2 : len(text) // 2] = passage
        texts.append(" ".join(text))
        if k % 7 == 0:
            texts += [texts[-1], texts[-1] + " more"]
    texts += ["# $ % " * 40, "the same line\n" * 30, "", None, "  \n", " ".join(rng.choice(words) for _ in range(9000))]
    source = lambda k: None if k % 13 == 0 else "hot" if k % 3 == 0 else f"s{k % 4}"
    rows = [(k + 1, t, "en", source(k), len(t or ""), *range(len(EXTRA))) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]


def cut_of(texts, size):
    """Texts without the words of windows that occur twice or more."""
    split = [t.split() for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for w in split:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def pieces_of(rows, capacity):
    """(doc_id, piece, start, length, ids_crc32) by the tokenizer itself."""
    found = Tokenizer.from_file(encode.tokenizer_path()).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    out = []
    for (doc_id, _), f in zip(rows, found, strict=True):
        ids = [*f.ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_stages_and_run_are_brute_force(spark, tmp_path):
    stages, rows = dict(corpus_pipeline.STAGES), made()
    docs = spark.createDataFrame(rows, SCHEMA)
    path = lambda name: f"file://{tmp_path}/{name}"

    def after(name, held):
        out = stages[name](spark, held, "")
        assert out.columns == docs.columns
        out.write.parquet(path(name))
        return spark.read.parquet(path(name))

    # Rejected: fewer than three words, symbols, repeated lines. The repeated rows are still there.
    good = after("quality_rules", docs)
    clean = [r for r in rows if len((r[1] or "").split()) > 2 and "#" not in r[1] and "same line" not in r[1]]
    assert sorted(map(tuple, good.collect())) == sorted(clean, key=lambda r: r[0])

    # One row, that of the least id, for each group of linked texts.
    unique = after("near_duplicates", good)
    first = {c for _, _, c in groups_of([(r[0], r[1]) for r in clean], 5, 80)}
    distinct = {r[0]: r for r in clean}
    assert sorted(map(tuple, unique.collect())) == sorted(distinct[k] for k in first) and len(first) < len(distinct)

    # Passages of 50 words that occur again are out, of all documents.
    cut = after("repeated_passages", unique)
    ids = sorted(first)
    want = dict(zip(ids, cut_of([distinct[k][1] for k in ids], 50), strict=True))
    held = {r["doc_id"]: r for r in cut.collect()}
    assert {k: r["text"].split() for k, r in held.items()} == want and sum(len(distinct[k][1].split()) - len(want[k]) for k in ids) >= 9 * 70
    assert all(tuple(r[c] for c in EXTRA) == tuple(range(len(EXTRA))) for r in held.values())

    # Each source takes its target to the word; a row is a document, or its beginning for the one that is cut.
    mixed = after("source_mix", cut)
    names = sorted({r["source"] for r in held.values()}, key=lambda n: (n is None, n or ""))
    sizes = [sum(len(want[k]) for k in ids if held[k]["source"] == n) for n in names]
    target = dict(zip(names, shared_out(sizes, mixing.cyclic_weights(names)), strict=True))
    taken, times, partial = dict.fromkeys(names, 0), {}, dict.fromkeys(names, 0)
    for r in mixed.collect():
        words = r["text"].split()
        taken[r["source"]] += len(words)
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + len(words)
        partial[r["source"]] += len(words) < len(want[r["doc_id"]])
        assert r["source"] == held[r["doc_id"]]["source"] and set(words) <= set(want[r["doc_id"]])
        assert len(want[r["doc_id"]]) > 1024 or words == want[r["doc_id"]][: len(words)]
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    assert all(n <= 3 * len(want[k]) for k, n in times.items())

    # Whole pieces, sequences without gaps, and as few of them as the bound says, or one more.
    packed = stages["packed_sequences"](spark, mixed, "").collect()
    exact = pieces_of([(r["doc_id"], r["text"]) for r in mixed.collect()], corpus_pipeline.CAPACITY)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == exact
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= corpus_pipeline.CAPACITY
    bound = packing.lower_bound(np.bincount([r["length"] for r in packed], minlength=corpus_pipeline.CAPACITY + 1), corpus_pipeline.CAPACITY)
    assert bound <= len(sequences) <= bound + 1

    # run() is the stages one after the other.
    docs.repartition(3).write.parquet(path("in/documents.parquet"))
    ran = corpus_pipeline.run(spark, path("in"))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in ran.collect()) == exact


def test_each_stage_on_an_empty_table_and_on_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(k, t, None, s, None, *range(len(EXTRA))) for k, t, s in [(1, None, None), (1, None, None), (None, "", "a"), (2, " \t", "a"), (3, "x", "b"), (3, "x", "b"), (None, "x y z", None)]], SCHEMA)
    kept = {"quality_rules": 1, "near_duplicates": 5, "repeated_passages": 7}  # of rows with equal id and text one stays
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, empty, "")
        assert out.count() == 0 and (out.columns == empty.columns or name == "packed_sequences")
        rows = step(spark, odd, "").collect()
        if name in kept:
            assert len(rows) == kept[name], name
        if name == "source_mix":
            assert rows and all(r["text"].split() for r in rows)
        if name == "packed_sequences":
            assert len(rows) == 7 and sorted(r["offset"] for r in rows)[0] == 0
