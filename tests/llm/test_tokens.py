"""Byte-level BPE, packing and token files against the libraries and plain versions."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granulon.llm import bpe, packing, queries, tokenfile, words

RANKS = public_tokenizers.path(queries.BYTE_RANKS)
VOCABULARY = public_tokenizers.path(queries.WORD_VOCABULARY)
ours = bpe.load(RANKS, public_tokenizers.PATTERN)
theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
library = Tokenizer.from_file(VOCABULARY)
library.encode_special_tokens = True
encoder = words.WordEncoder(VOCABULARY)
TEXTS = ["", " ", "a" * 3000, "the the  the\n\n 's't 12345 ", "日本語🎉ñ́é", "\x00\x01 <|endoftext|>", "don't stop, (now)... é,á! x̄, ab.cd"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(text):
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_bpe_and_words_equal_the_libraries_on_any_text(text):
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_prefixes_appends_and_edits():
    rng = random.Random(3)
    for _ in range(100):
        data = "".join(rng.choice("abcdeth es1é") for _ in range(rng.randint(1, 300))).encode()
        i = rng.randint(0, len(data))
        j = rng.randint(i, len(data))
        new = bytes(rng.choice(b"abth e") for _ in range(rng.randint(0, 5)))
        table = ours.table(data)
        assert table.ids(i) == ours.table(data[:i]).ids()
        done = table.edit(i, j, new)
        assert table.last == ours.table(data[:i] + new + data[j:]).last
        assert done <= len(data) - j + len(new)
        grown = ours.table(data[:i])
        grown.append(data[i:])
        assert grown.last == ours.table(data).last


def test_an_edit_of_a_long_text_is_local():
    data = ("abc def " * 5000).encode()
    table = ours.table(data)
    assert table.edit(20, 22, b"xy") < 200


def test_bpe_documents(spark, odd, none):
    got = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    found = {(r.doc_id, tuple(r.ids)) for r in got.collect()}
    assert found == {(r.doc_id, tuple(theirs.encode_ordinary(r.text or ""))) for r in odd.collect()}
    back = bpe.decode_documents(got, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in odd.collect())
    digests = {r.doc_id: r for r in bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert digests[1].n_tokens == 0 and digests[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == digests[1].decoded_sha256
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([7, 50, 2048]), st.data())
def test_plan_equals_plain_best_fit_decreasing(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=120))
    counts = {x: lengths.count(x) for x in lengths}
    keys, first, each, offset = packing.df_moves(packing.plan(counts, capacity))
    bins = {}
    for x, n in counts.items():
        for k in range(n):
            at = np.searchsorted(keys, x * (1 << 44) + k, side="right") - 1
            into = k - (keys[at] & ((1 << 44) - 1))
            bins.setdefault(int(first[at] + into // each[at]), []).append((int(offset[at] + into % each[at] * x), x))
    assert len(bins) == plain_best_fit(lengths, capacity)
    for placed in bins.values():
        end = 0
        for at, x in sorted(placed):
            assert at == end
            end += x
        assert end <= capacity


def test_lengths_beyond_the_capacity_are_an_error():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def check_packed(df, texts, capacity):
    got = df.toPandas()
    by_sequence = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in by_sequence:
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= capacity
    lengths = []
    for text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        lengths += [min(capacity, n - at) for at in range(0, n, capacity)]
    assert sorted(got.length) == sorted(lengths)
    assert got.sequence_id.nunique() == plain_best_fit(lengths, capacity)
    return got


def test_pack(spark, odd, none):
    got = check_packed(packing.pack(odd, VOCABULARY), [r.text for r in odd.collect()], 2048)
    for doc, text in (("", ""),):
        assert zlib.crc32(np.array([0], "<u4").tobytes()) in got.ids_crc32.tolist()
    assert packing.pack(none, VOCABULARY).count() == 0


def test_many_of_one_length_are_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    texts = ["same words here"] * 100 + ["other"] * 31
    check_packed(packing.pack(rows(spark, texts), VOCABULARY, capacity=16), texts, 16)


def test_sequences_hold_the_ids(spark):
    texts = ["one two three", "four five", "six " * 30]
    pieces = packing.cut_documents(rows(spark, texts), VOCABULARY, 16, 0, with_ids=True)
    found = packing.sequences(packing.place(pieces, 16)).collect()
    assert sum(r.n_tokens for r in found) == sum(len(r.ids) for r in found) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 32])
def test_bits(bits):
    ids = np.array([random.getrandbits(bits) for _ in range(1000)], np.uint32)
    packed = tokenfile.pack_bits(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (tokenfile.unpack_bits(packed, 1000, bits) == ids).all()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 1000, 0, 7)]
    sink = io.BytesIO()
    writer = tokenfile.Writer(sink, tokenfile.width(5000), block=64)
    for k, ids in enumerate(docs):
        writer.add(None if k == 0 else k, ids)
    writer.close()
    reader = tokenfile.Reader(Source(sink.getvalue()))
    assert reader.bits == 13
    for k in (5, 2, 0, 7, 3, 1, 6, 4):
        assert (reader.document(k) == docs[k]).all()
        assert reader.doc_id(k) == (None if k == 0 else k)
    with pytest.raises(ValueError):
        tokenfile.Reader(Source(sink.getvalue()[:-1]))


def test_token_files(spark, odd, none, tmp_path):
    listed = tokenfile.write(odd, VOCABULARY, str(tmp_path), 1, files=3)
    found = tokenfile.read(spark, str(tmp_path), listed, with_ids=True).collect()
    expected = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect())
    start = 0
    assert len(found) == len(expected)
    for got, (known, doc, text) in zip(sorted(found, key=lambda r: r.start), expected):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (got.doc_id, got.start, got.n_tokens, got.ids) == (doc if known else None, start, len(ids), ids)
        assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".tokens")]
    assert tokenfile.round_trip(none, VOCABULARY).count() == 0
