import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinforge.llm import bpe, bpe_ops, packing, queries
from kinforge.llm.ragged import chunks, hash_slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "'s", "'ll", "'", "1", "²", "१", "क", "ि", "!", "?", "\xa0", " ", "　", "\x1c", "\x85", "—", "’", "😀", "‍", "Ω", "中", "aaaa", "<|", " \n", "\r\n", " ", "_", "\x00", "﻿", "ⅷ", "×", "thing", "."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode(texts):
    out = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        ids, n = bpe.encoder(PATH).encode(data, offsets)
        end = np.cumsum(n)
        out += [ids[b - k : b] for b, k in zip(end, n, strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    library = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_the_library, "t") else test_ids_equal_the_library.t
    test_ids_equal_the_library.t = library
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert bpe.encoder(PATH).decode(ids).decode("utf-8", "replace") == text


def test_a_full_table_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "MAX_UNITS", 50)
    code = bpe.Encoder(PATH)
    for k in range(5):
        texts = [" ".join(f"x{k}{i}{j}" for j in range(20)) for i in range(2)]
        for _, _, data, offsets in chunks(pa.array(texts)):
            ids, _ = code.encode(data, offsets)
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_units_that_share_a_hash_are_told_apart(monkeypatch, library, bits):
    """Forced collisions of the hash (the first eight bytes are compared beside it)."""

    def collide(buffer, start, end):
        h, head = hash_slices(buffer, start, end)
        return h >> np.uint64(64 - bits) if bits else h * np.uint64(0), head

    monkeypatch.setattr(bpe, "hash_slices", collide)
    code = bpe.Encoder(PATH)
    texts = ["one internationalisation two", "internationalization internationalisations one", "x two three 12345678a 12345678b", "", "one two"]
    for _ in range(2):
        raw = [t.encode() for t in texts]
        ids, n = code.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_query(spark, sf, doc_rows, library):
    got = {r["doc_id"]: r for r in queries.op3_bpe_round_trip(spark, sf).collect()}
    assert len(got) == len(doc_rows)
    for doc_id, text in doc_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(odd, odd_rows, library):
    got = bpe_ops.round_trip(odd).collect()
    want = sorted(((i or -1), t or "") for i, t in odd_rows)
    assert sorted(((r["doc_id"] or -1), r["decoded"]) for r in got) == want
    for r in got:
        assert list(r["ids"]) == library.encode(r["decoded"], add_special_tokens=False).ids
    decoded = bpe_ops.decode(bpe_ops.encode(odd)).collect()
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in decoded) == want
    assert bpe_ops.round_trip(odd.limit(0)).count() == 0


def test_invalid_bytes_become_replacement_characters(spark, library):
    ids = library.encode("é€", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe_ops.decode(df).collect()}
    assert got == {1: library.decode(ids[:1], skip_special_tokens=False), 2: "", 3: ""}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=8), st.sampled_from([1, 2, 64, 1024]))
def test_decompose(sizes, most):
    row, start, length = packing.decompose(np.array(sizes, np.int64), most)
    for i, n in enumerate(sizes):
        mine = row == i
        assert length[mine].sum() == n and (np.cumsum(length[mine]) - length[mine] == start[mine]).all()
        assert all(x & (x - 1) == 0 and x <= most for x in length[mine].tolist())
        assert sum(length[mine] < most) == bin(n % most).count("1")


def test_packing_query(spark, sf, doc_rows, library):
    rows = queries.op1_power_of_two_packing(spark, sf).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in doc_rows}
    for doc_id, text in doc_rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["offset"] == 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] == 1 << r["bucket"] for r in rows)


def test_packing_odd_texts(odd, odd_rows, library):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(np.array([3]), 100)
