"""Encoding, the token store and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from marketspark.llm import encode, packing, token_store

PATH = encode.tokenizer_path()


def texts(n, seed=1):
    rng = random.Random(seed)
    signs = "ÀÉßý×÷aB1'<|>é \n,.%́Σ\x85"
    odd = ["", None, "Hello's <|endoftext|>x 12ab \x1f ÀB́ σΣ İ 你好,abc…— don´t é x", "x" * 5000 + " " + "é" * 3000, "it'll I'LL ''"]
    return odd + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(n)] + [" ".join(rng.choice(["alpha", "Beta,", "gamma"]) for _ in range(k)) for k in (5000, 12000, 4095, 4096)]


def ids_of(found):
    return [f.ids for f in Tokenizer.from_file(PATH).encode_batch(found, add_special_tokens=False)]


def test_pieces_give_the_tokenizers_ids():
    some = texts(1500)
    got = []
    for _, _, ids, offsets in encode.Encoder(PATH).encode(pa.array(some, pa.string()), 1000):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == ids_of([t or "" for t in some])


def test_other_tokenizers_encode_whole_texts():
    path = encode.tokenizer_path("byte_bpe_50k.json")
    some = ["a b  c", "", "x\n y"]
    ((_, _, ids, offsets),) = encode.Encoder(path).encode(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [f.ids for f in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_reads_back_what_was_written(spark):
    some = list(enumerate(texts(200)))
    random.Random(2).shuffle(some)
    got = token_store.encode_and_read_back(spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, row int"), files=5).collect()
    start, want = 0, []
    for (doc_id, _), ids in zip(sorted(some), ids_of([t or "" for _, t in sorted(some)]), strict=True):
        want.append((doc_id, start, len(ids) + 1, crc([*ids, 2])))
        start += len(ids) + 1
    assert sorted(map(tuple, got)) == want


def test_store_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (None, "b c"), (1, None)], "doc_id long, text string")
    got = sorted(map(tuple, token_store.encode_and_read_back(df).select("start", "n_tokens").collect()))
    assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got[:-1], got[1:], strict=True))
    assert token_store.encode_and_read_back(df.limit(0)).count() == 0


def test_packing_places_every_piece_once(spark):
    some = list(enumerate(texts(300))) + [(3, "again"), (3, "again"), (None, "x")]
    packed = packing.pack_documents(spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, bin int"), 4096, group_pieces=60)
    rows = packed.collect()
    want = []
    for (doc_id, _), ids in zip(some, ids_of([t or "" for _, t in some]), strict=True):
        ids = [*ids, 1]
        want += [(doc_id, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096]), ids[a : a + 4096]) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in rows))) == sorted(map(str, want))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    n, least = packing.certificate(packed)
    assert n == len(sequences) and least <= n <= least + 1


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, lengths).max() <= 100
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= bins.max() + 1
    for lengths, least in (([51] * 7, 7), ([34] * 6, 3), ([], 0)):
        assert packing.lower_bound(np.bincount(np.array(lengths, np.int64), minlength=101), 100) == least


def fewest_bins(lengths, capacity):
    """By trying every way."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= capacity:
                place(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_packing_against_all_ways(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        lengths = sorted(rng.integers(1, 11, 8).tolist(), reverse=True)
        least = fewest_bins(lengths, 10)
        assert packing.lower_bound(np.bincount(lengths, minlength=11), 10) <= least
        packed = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), 10)
        assert packed.select("sequence_id").distinct().count() <= least + 1


def test_groups_with_a_gap_exchange_pieces(spark):
    """Many groups, each left with bins that only others' pieces can fill."""
    rng = np.random.default_rng(7)
    lengths = rng.integers(20, 60, 2000).tolist()
    df = spark.createDataFrame([(n, 0, 0) for n in lengths], "length long, gap long, _uid int")
    alone = packing.pack(df, 100, group_pieces=100, release=0.0)
    packed = packing.pack(df, 100, group_pieces=100, release=0.2)
    assert packed.columns == ["length", "_uid", "sequence_id", "offset", "gap"] and packed.count() == 2000
    used = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r["sum(length)"] for r in used) <= 100
    assert packing.certificate(packed, 100)[0] <= packing.certificate(alone, 100)[0]
    assert packed.where("sequence_id >= %d" % (1 << 52)).count() > 0


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
