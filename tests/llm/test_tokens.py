import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequarry.llm import rangecoder, tokenfiles, tokens

from .conftest import rows


@pytest.fixture(scope="module")
def encoder():
    return tokens.TextEncoder(tokens.default_vocabulary(), most=500)


def library(encoder, texts):
    return [e.ids for e in encoder.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet=" \n\t\x0b　abZ'sé漢1!.,<|", max_size=40), max_size=5))
def test_pieces_give_the_library_s_ids(texts):
    enc = tokens.encoder(tokens.default_vocabulary())
    ids, n = enc.encode(texts, 0)
    assert ids.tolist() == sum(([*x, 0] for x in library(enc, texts)), []) and n.tolist() == [len(x) + 1 for x in library(enc, texts)]


@settings(deadline=None, max_examples=1000)
@given(st.lists(st.text(alphabet="  \n\nab'st.,_9\t\r\x1c\x85\xa0×÷çÉ\u0301\u2003—٣½漢😀", max_size=12), max_size=6))
def test_cuts_beside_odd_signs_give_the_library_s_ids(texts):
    enc = tokens.encoder(tokens.default_vocabulary())
    ids, n = enc.encode(texts)
    assert ids.tolist() == sum(library(enc, texts), []) and n.tolist() == [len(x) for x in library(enc, texts)]


def test_signs_and_lines_do_not_make_new_pieces():
    enc = tokens.TextEncoder(tokens.default_vocabulary())
    words = ["alpha", "beta", "gamma", "été"]
    enc.encode([a + sign + b for a in words for b in words for sign in (" ", ", ", ".\n", "; ", "!\n")])
    assert len(enc.memory) <= 2 * len(words) + 6  # each word with and without a blank, four signs, the line's end, nothing


def test_nulls_special_strings_and_a_small_memory(encoder):
    texts = [None, "", "<|endoftext|>", "don't we've 's", *(r[1] for r in rows())]
    for _ in range(2):
        ids, n = encoder.encode(texts)
        assert ids.tolist() == sum(library(encoder, texts), []) and n[0] == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 60_000))
def test_coder_round_trip(ids, top):
    x = np.array([i * top % 200_000 for i in ids], np.int64)
    assert (rangecoder.decode(rangecoder.encode(x)) == x).all()


def test_coder_adapts_and_detects_changes():
    x = np.tile(np.arange(50) * 7, 2000)
    block = rangecoder.encode(x)
    assert len(block) < len(x) / 4
    for k in (3, 20, 40, len(block) - 1):
        bad = bytearray(block)
        bad[k] ^= 1
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode(bytes(bad))
    with pytest.raises(rangecoder.CorruptBlock):
        rangecoder.decode(block[:10])


def test_coder_mixes_orders_well_below_order_zero(encoder):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    x = encoder.encode(texts, 0)[0].astype(np.int64)
    share = np.bincount(x)[np.unique(x)] / len(x)
    block = rangecoder.encode(x)
    assert (rangecoder.decode(block) == x).all()
    assert 8 * len(block) / len(x) < 0.87 * -(share * np.log2(share)).sum()


@pytest.mark.parametrize("n", (1, 2, 255, 1023, 1025, 4097, 70_000))
def test_coder_round_trip_over_what_it_learns(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(0, 3, n)) * 37 % 50_000  # what follows depends on the id before
    block = rangecoder.encode(x)
    assert (rangecoder.decode(block) == x).all()


def test_files_hold_documents_in_order(spark, docs, nothing, encoder, tmp_path):
    tokenfiles.write(docs, str(tmp_path / "f"), block=700)
    got = tokenfiles.read(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    want = sorted(((i is not None, i or 0, t or ""), i, t) for i, t, *_ in rows())
    assert [r["doc_id"] for r in got] == [i for _, i, _ in want]
    start = 0
    for r, (_, _, t) in zip(got, want):
        ids = [*encoder.encode([t])[0].tolist(), 0]
        assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokenfiles.write(nothing, str(tmp_path / "e"))
    assert tokenfiles.read(spark, str(tmp_path / "e")).count() == 0


def test_coder_renews_its_shares_less_often_as_it_grows(monkeypatch):
    times = []
    weigh = rangecoder._Model._weigh
    monkeypatch.setattr(rangecoder._Model, "_weigh", lambda model: (times.append(model.learnt), weigh(model)))
    x = np.random.default_rng(1).zipf(1.3, 1 << 21) % 50_000
    assert (rangecoder.decode(rangecoder.encode(x)) == x).all()
    assert len(times) < 2 * 40  # both directions; 69 times each where they came every 32,768 ids


def test_coder_where_one_context_has_more_followers_than_slots():
    rng = np.random.default_rng(2)
    x = np.zeros(400_000, np.int64)
    x[1::2] = np.where(rng.random(200_000) < 0.5, 1, rng.integers(2, 9000, 200_000))
    assert (rangecoder.decode(rangecoder.encode(x)) == x).all()


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, (1 << 35) - 1), min_size=1, max_size=400), st.lists(st.integers(0, (1 << 35) - 1), max_size=50))
def test_finder_finds_each_key_and_no_other(keys, others):
    have = np.array(sorted(keys), np.int64)
    wanted = np.array([*keys, *others], np.int64)
    hit, place = rangecoder._Finder(have).find(wanted)
    assert sorted(hit.tolist()) == [k for k, w in enumerate(wanted.tolist()) if w in keys] and (have[place] == wanted[hit]).all()


def test_finder_with_keys_that_reach_the_later_tables():
    finder = rangecoder._Finder(np.arange(50_000) * 3)
    hit, place = finder.find(np.arange(150_000))
    assert sorted(hit.tolist()) == list(range(0, 150_000, 3)) and (place * 3 == hit).all()
