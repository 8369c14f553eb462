import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import packing, token_counts

from .fixtures import awkward, empty

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "\xa0", "1", "23", "!!", "<|endoftext|>", "ll", "aaaa", "\x1c", "\x85", "don't", "—", "🙂", " <", "the", "ing"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)] + ["a" * 4000, "ab" * 2000, " " * 999, "\n\n\nfoo   bar ", ""]


@pytest.fixture(scope="module")
def ids(texts):
    return [e.ids for e in tokenizers.Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(texts, ids):
    assert token_counts.Counter(PATH)(texts) == list(map(len, ids))
    assert token_counts.Counter(PATH, cache=10)(texts[:200]) == list(map(len, ids[:200]))


def test_ids_equal_the_library(texts, ids):
    assert packing.Encoder(PATH)(texts) == [np.array(i, "<u4").tobytes() for i in ids]


@pytest.mark.parametrize("text", [
    " " * 2_000_000 + "x", "a" + "\n" * 2_000_000 + "x", "one " + " \t\n" * 700_000 + "\xa0two" + " " * 2_000_000, "<|endoftext|>" + " " * 1_200_000 + "<|endoftext|>'s", "é" + "\u3000" * 60_000 + " the",
    " " * 1_200_000 + "1" + "\n" * 49_999 + "x" + "\x1c" * 60_000 + " " * 50_000 + "!",
])
def test_long_white_space(text):
    want = tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert packing.Encoder(PATH)([text]) == [np.array(want, "<u4").tobytes()]


def test_count_rows(spark):
    got = token_counts.count_tokens(awkward(spark), PATH).collect()
    assert len(got) == 9 and {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} >= {(1, 0, 0), (2, 0, 0)}
    assert [r.over_limit for r in got if r.doc_id == 4] == [True]
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0


def pieces_are_whole(rows, lengths, capacity):
    """Rows rebuild every document, and fill sequences without gap or overflow."""
    at = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(r.length for r in rows) == sum(lengths)
    assert all(r.length == capacity for r in rows if r.piece)
    return len(at)


def test_pack_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "thing", "ofthe", "ed", "an"], k=rng.randint(0, 90))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack(df, PATH, capacity=64, keep_ids=True, group=50).collect()
    want = [[*e.ids, 0] for e in tokenizers.Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    used = pieces_are_whole(rows, list(map(len, want)), 64)
    assert used <= -(-sum(map(len, want)) // 64) + 6
    for k, w in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert b"".join(r.ids for r in own) == np.array(w, "<u4").tobytes()
        assert len(own) == (1 if len(w) <= 64 else -(-len(w) // 64))


def test_full_pieces_stay_out_of_the_groups(spark):
    books = [(k, " ".join(["the thing"] * 1600)) for k in range(40)] + [(k % 3, "the thing") for k in range(3)] * 2
    df = spark.createDataFrame(books, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, PATH, capacity=64, keep_ids=True, group=16).collect()
    full = [r for r in rows if r.length == 64]
    assert len(full) >= 40 * 49 and len({r.sequence_id for r in full}) == len(full) and {r.offset for r in full} == {0}
    lengths = [len(packing.Encoder(PATH)([t])[0]) // 4 + 1 for _, t in books]
    pieces_are_whole(rows, lengths, 64)
    short = [r.sequence_id for r in rows if r.length < 64]
    assert {r.sequence_id for r in full}.isdisjoint(short)
    # What a group was given is bounded by short pieces alone.
    assert max(Counter(r.sequence_id >> 32 for r in rows if r.sequence_id < 1 << 62 or r.length < 64).values()) <= 3 * 16


def test_pack_awkward_rows(spark):
    rows = packing.pack(awkward(spark), PATH).collect()
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) == 2
    assert packing.pack(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("low,high", [(700, 1300), (500, 1000), (600, 900), (1, 2048)])
def test_local_search_only_improves(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 600)
    first = packing.best_fit(sizes, 2048)
    better = packing.local_search(sizes, first, 2048)
    assert np.bincount(better, sizes).max() <= 2048
    assert len(set(better.tolist())) <= len(set(first.tolist()))
    if low == 500:
        assert len(set(better.tolist())) < len(set(first.tolist()))


def test_long_words_equal_the_library():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = ["a" * 3000, "ab" * 700, "the" * 2000, "é" * 999, "日本" * 400, "=" * 3000, "aaab" * 300 + "b" * 301, "x " + "".join(rng.choices("etaoin", k=20_000)) + " yes"]
    long += ["".join(rng.choices(letters, k=k)) for k in (255, 256, 257, 258, 5000)]
    want = [len(e.ids) for e in tokenizers.Tokenizer.from_file(PATH).encode_batch(long, add_special_tokens=False)]
    counter = token_counts.Counter(PATH)
    assert counter(long) == want
    assert max(map(len, [*counter.known, *counter.heads])) <= token_counts.LONG + 1


def test_a_word_of_two_million_letters():
    word = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    start = time.time()
    n = token_counts.Counter(PATH)([word])[0]
    assert time.time() - start < 30 and 1_000_000 < n < 1_400_000
    assert token_counts.Counter(PATH)(["a" * 2_000_000]) == [500_000]


def test_equal_pieces_are_packed_in_time(spark):
    start = time.time()
    bins = packing.local_search(np.full(8192, 700), packing.best_fit(np.full(8192, 700), 2048), 2048)
    assert len(set(bins.tolist())) == 4096 and time.time() - start < 5
    rows = spark.range(200_000).selectExpr("7L as doc_id", "'same text' as text")
    got = packing.pack(rows, PATH).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").toPandas()
    assert got.n.max() <= 2048 and got.n.sum() == 600_000 and len(got) <= -(-600_000 // 2048) + 25
