import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import packing, pair_bpe, simple8b, token_counts, token_store
from lodeline.llm.tokens import BYTE_BPE, WORD_BPE, encoder, library, vocabulary_path

from .cases import DOCUMENTS, ODD, as_set, clashing, rows

BYTE, WORD = vocabulary_path(BYTE_BPE), vocabulary_path(WORD_BPE)
ALPHABET = st.lists(st.sampled_from([*"ab'st 1!.,\n\t\réß\xa0́你\x1c\x85", "<|endoftext|>", " the"]), max_size=40).map("".join)


def ids(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_equals_library(path):
    texts = ODD + pq.read_table(DOCUMENTS)["text"].to_pylist()
    assert [x.tolist() for x in encoder(path).encode(texts)] == [ids(path, t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_encoders_on_any_text(text):
    for path in (BYTE, WORD):
        assert encoder(path).encode([text])[0].tolist() == ids(path, text)
    own = pair_bpe.pair_bpe(BYTE)
    assert own.encode([text])[0] == ids(BYTE, text)
    assert own.decode(ids(BYTE, text)) == library(BYTE).decode(ids(BYTE, text), skip_special_tokens=False)


def test_pair_bpe_on_documents():
    texts = ODD + pq.read_table(DOCUMENTS)["text"].to_pylist()
    own = pair_bpe.pair_bpe(BYTE)
    found = own.encode(texts)
    assert found == [ids(BYTE, t) for t in texts]
    assert [own.decode(x) for x in found] == [library(BYTE).decode(x, skip_special_tokens=False) for x in found]
    broken = found[-1][3:7] + [own.byte_ids[0xE4], own.byte_ids[0xB8], 0]
    assert own.decode(broken) == library(BYTE).decode(broken, skip_special_tokens=False)


def test_pair_bpe_query(spark):
    texts = [None, "", *ODD, "same", "same"]
    got = {r.doc_id: r for r in pair_bpe.round_trip(clashing(rows(spark, texts)), BYTE).collect()}
    for i, t in enumerate(texts):
        want = ids(BYTE, t or "")
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library(BYTE).decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert pair_bpe.round_trip(rows(spark, []), BYTE).count() == 0
    back = pair_bpe.decoded(pair_bpe.encoded(rows(spark, texts), BYTE), BYTE)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_simple8b_round_trip(values, block):
    x = np.array(values, np.uint64)
    words, starts = simple8b.encode(x, block)
    assert (simple8b.decode(words, starts) == x).all()
    for b in range(len(starts)):
        assert (simple8b.decode(words, starts, b, b + 1) == x[b * block : (b + 1) * block]).all()


def test_simple8b_packs():
    words, _ = simple8b.encode(np.zeros(4080, np.uint64))
    assert len(words) == 68
    words, _ = simple8b.encode(np.full(4096, 30000, np.uint64))
    assert len(words) == 1024


def test_token_store(spark, tmp_path):
    random.seed(5)
    texts = [None, "", "word " * 5000, *ODD, "twin", "twin"]
    df = rows(spark, texts).orderBy("n_chars")
    token_store.write(clashing(df).repartition(3), f"{tmp_path}/s", WORD, segment_ids=100)
    got = {r.doc_id: r for r in token_store.read_documents(spark, f"{tmp_path}/s").collect()}
    start = 0
    for i, t in enumerate(texts):
        want = np.array([*ids(WORD, t or ""), 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    token_store.write(rows(spark, []), f"{tmp_path}/e", WORD)
    assert token_store.read_documents(spark, f"{tmp_path}/e").count() == 0


def test_counts_of_huge_texts(spark):
    random.seed(1)
    mixed = "".join(random.choice(["the ", "a", "'s", " <|endoftext|>", "\n", "  ", "1", "!", "é"]) for _ in range(4000))
    solid = "x" * 5000 + " y " + "z" * 3000
    texts = [None, "", "short one", mixed, mixed, solid, " " * 3000, "<|endoftext|>" * 400]
    got = {r.doc_id: r for r in token_counts.counted(clashing(rows(spark, texts)), BYTE, chunk_chars=200, overlap=64).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(ids(BYTE, t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.counted(rows(spark, []), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=80))
def test_pack_keeps_every_id(lengths):
    found = packing.pack(lengths, 2048)
    seen = [np.zeros(n, int) for n in lengths]
    odd = 0
    for s in found:
        n = sum(p[2] for p in s)
        assert 0 < n <= 2048 and all(p[2] > 0 for p in s)
        odd += n != 2048
        assert n & (n - 1) == 0
        for d, start, k in s:
            seen[d][start : start + k] += 1
    assert all((x == 1).all() for x in seen)
    assert odd <= 11


def test_tournament_is_first_fit():
    random.seed(3)
    tree, rooms = packing.Rooms(64, 100), [100] * 64
    for need in (random.randint(1, 100) for _ in range(60)):
        want = next(i for i, r in enumerate(rooms) if r >= need)
        rooms[want] -= need
        assert tree.first_fit(need) == want


def test_packing_query(spark):
    texts = [None, "", "word " * 9000, *ODD, "twin", "twin"]
    got = packing.packed(clashing(rows(spark, texts)), BYTE, group_docs=10).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        want, at = np.array([*ids(BYTE, t or ""), 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.packed(rows(spark, []), BYTE).count() == 0


def test_null_ids_and_long_texts(spark):
    long = "word, and more words. " * 40_000 + "x" * 3000
    data = spark.createDataFrame([(None, "twin"), (None, "twin"), (None, None), (5, long)], "doc_id bigint, text string")
    sizes = sorted(len(ids(BYTE, t)) for t in ("twin", "twin", "", long))
    assert sorted(r.n_tokens for r in token_counts.counted(data, BYTE).collect()) == sizes
    assert sorted(r.n_tokens for r in pair_bpe.round_trip(data, BYTE).collect()) == sizes
    pieces = packing.packed(data, BYTE).collect()
    assert sum(r.length for r in pieces) == sum(sizes) + 4


def test_store_with_null_ids(spark, tmp_path):
    data = spark.createDataFrame([(None, "b a"), (3, "c"), (None, None)], "doc_id bigint, text string")
    token_store.write(data, f"{tmp_path}/s", WORD)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read_documents(spark, f"{tmp_path}/s").collect())
    assert [r[1] for r in got] == [None, None, 3] and got[2][0] == got[0][2] + got[1][2]
