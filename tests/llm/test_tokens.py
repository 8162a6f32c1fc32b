"""Tokenizer operators (1, 5, 6, 8) and their arrays against the public libraries."""

import hashlib
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import bpe_codec, byte_bpe, packing, simple8b, token_counts, token_output
from logloom.llm.queries import tokenizer_path

BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def pieces(s):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(s or "")


ALPHABET = st.sampled_from(list("aábcÉ×'sS ,.!\n\t\r|<>_-12ß日   ▁İΣ́") + ["<|endoftext|>", "'ll", "the ", "  ", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "THE"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_arrays_equal_the_libraries(texts):
    column = pa.array([*texts, None], pa.string())
    for path in (BYTE, WORD):
        bpe, want = byte_bpe.load(path), library(path)
        for merge in (bpe.table.merge_all, lambda s, n, bpe=bpe: bpe_codec.merge_by_index(bpe.table, s, n)):
            ids, at = bpe.encode(column, merge)
            for i, s in enumerate(column.to_pylist()):
                assert ids[at[i] : at[i + 1]].tolist() == want(s)
    sizes, n = token_counts.counter(PIECE).count(column)
    assert n.tolist() == [len(pieces(s)) for s in column.to_pylist()] and sizes.tolist() == [len((s or "").encode()) for s in column.to_pylist()]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "=" * 2500, "\n" * 1500 + "e", "".join("theandiongrst"[k * k * 7919 % 13] for k in range(4000)), "日本" * 900 + "x" * 2000])
def test_long_sequences(text):
    """Beyond merges.LONG symbols."""
    for path in (BYTE, WORD):
        bpe = byte_bpe.load(path)
        for merge in (bpe.table.merge_all, lambda s, n, bpe=bpe: bpe_codec.merge_by_index(bpe.table, s, n)):
            assert bpe.encode(pa.array([text]), merge)[0].tolist() == library(path)(text)
    assert token_counts.counter(PIECE).count(pa.array([text]))[1][0] == len(pieces(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300), max_size=6))
def test_simple8b_round_trip(lists):
    lengths = np.array([len(x) for x in lists], np.int64)
    values = np.array([v for x in lists for v in x], np.uint64)
    words, used, n_blocks = simple8b.encode(values, lengths)
    assert len(words) == used.sum() and n_blocks.tolist() == [-(-n // 128) for n in lengths]
    sizes = [min(128, n - 128 * k) for n in lengths.tolist() for k in range(-(-n // 128))]
    assert (simple8b.decode(words, used, np.array(sizes, np.int64)) == values).all()
    if len(words):  # any block alone
        k = len(used) - 1
        assert (simple8b.decode(words[used[:k].sum() :], used[k:], np.array(sizes[k:])) == values[sum(sizes[:k]) :]).all()


def test_simple8b_encode_costs_little():
    """Beside a sort of as many numbers; measured 1.7 times that, and 15 times with a window of 60 gathered for each word."""
    values = np.random.default_rng(0).integers(0, 50_000, 1_000_000).astype(np.uint32)

    def seconds(f):
        found = []
        for _ in range(3):
            began = time.process_time()
            f()
            found.append(time.process_time() - began)
        return min(found)

    assert seconds(lambda: simple8b.encode(values, np.full(1000, 1000))) < 6 * seconds(lambda: np.sort(values.astype(float)))


def test_simple8b_words_of_a_block_end():
    """The last word of a block takes nothing from the next list, whatever its values' size."""
    values, lengths = np.array([1, 1, 2**40, 3, 2**64 - 1, 0, 2**60], np.uint64), np.array([2, 1, 0, 2, 2])
    words, used, n_blocks = simple8b.encode(values, lengths)
    assert words.tolist() == [1 << 4 | 1 << 5, 13 | 2**44, 13 | 3 << 4, 15, 2**64 - 1, 13, 15, 2**60]
    assert (used.tolist(), n_blocks.tolist()) == ([1, 1, 3, 3], [1, 1, 0, 1, 1])


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def by_row(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("table", ["docs", "hard"])
def test_codec(request, table):
    df, encode = request.getfixturevalue(table), library(BYTE)
    want = []
    for r in df.collect():
        ids = encode(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert by_row(bpe_codec.codec_digests(df, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_codec_returns_ids_and_text(hard, none):
    for r in bpe_codec.encode_decode(hard, BYTE).join(hard.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "") and r.ids == library(BYTE)(r.text)
    assert bpe_codec.encode_decode(none, BYTE).count() == bpe_codec.codec_digests(none, BYTE).count() == 0


@pytest.mark.parametrize("table", ["docs", "hard"])
def test_counts(request, table):
    df = request.getfixturevalue(table)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(pieces(r.text)), n > 50) for r in df.collect()]
    assert by_row(token_counts.count_tokens(df, PIECE, 50), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


@pytest.mark.parametrize("table", ["docs", "hard"])
def test_token_files(request, table, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_IDS", 500)
    df, encode = request.getfixturevalue(table), library(BYTE)
    got = token_output.token_files(df, BYTE, 2).collect()
    texts = sorted(((r.doc_id is not None, r.doc_id, len(encode(r.text)) + 1, crc([*encode(r.text), 2])) for r in df.collect()), key=lambda x: (x[0], x[1] or 0))
    start, want = 0, []
    for _, i, n, c in texts:
        want.append((i, start, n, c))
        start += n
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_files_hold_the_ids(spark, docs, tmp_path):
    token_output.write_token_files(docs, BYTE, 2, str(tmp_path / "f"))
    got = {r.doc_id: r.ids for r in token_output.read_token_files(spark, str(tmp_path / "f"), with_ids=True).collect()}
    assert all(got[r.doc_id] == [*library(BYTE)(r.text), 2] for r in docs.collect())


def test_no_rows(none):
    assert token_output.token_files(none, BYTE, 2).count() == token_counts.count_tokens(none, PIECE, 1).count() == packing.pack_documents(none, WORD, 2, packing.Limits()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200)), max_size=40), st.sampled_from([(64, 3, 20), (64, 64, 64), (16, 1, 16), (128, 200, 1)]))
def test_packing_invariants(items, limits):
    limits = packing.Limits(*limits)
    tokens = np.array([t for t, _ in items], np.int64)
    loss = np.minimum([x for _, x in items], tokens).astype(np.int64)
    got, n = packing.pack_group(tokens, loss, limits)
    seen = [np.zeros(t, int) for t in tokens]
    for i, start, length, _, _ in got:
        seen[i][start : start + length] += 1
    assert all((s == 1).all() for s in seen)
    for q in range(n):
        rows = got[got[:, 3] == q]
        rows = rows[np.argsort(rows[:, 4])]
        used = int(rows[:, 2].sum())
        assert rows[:, 4].tolist() == (np.cumsum(rows[:, 2]) - rows[:, 2]).tolist()
        assert 0 < used <= limits.tokens and used & (used - 1) == 0 and len(rows) <= limits.segments
        assert sum(max(0, s + k - max(s, tokens[i] - loss[i])) for i, s, k, _, _ in rows) <= limits.loss


def test_packing_prefers_what_fits():
    got, n = packing.pack_group(np.array([10, 6, 10, 6]), np.array([10, 6, 10, 6]), packing.Limits(16, 4, 16))
    assert n == 2 and len(got) == 4


@pytest.mark.parametrize("table", ["docs", "hard"])
def test_pack_documents(request, table):
    df, encode = request.getfixturevalue(table), library(WORD)
    got = packing.pack_documents(df, WORD, 2, packing.Limits(), with_ids=True).collect()
    pieces_ = {}
    for r in got:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        pieces_.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for r in df.collect():
        own = sorted(pieces_[r.doc_id])
        if r.doc_id != 5 or table == "docs":  # the repeated row has its pieces twice
            assert [x for p in own for x in p[1]] == [*encode(r.text), 2] and own[0][2] == len(encode(r.text)) + 1


def test_pack_examples(spark):
    df = spark.createDataFrame([("a", 10, 3), ("b", 5, 9), ("a", None, None), (None, 3, 0)], "id string, tokens int, loss int")
    got = packing.pack_examples(df, packing.Limits(8, 4, 4), "id", "tokens", "loss").collect()
    assert sum(r.length for r in got) == 18 and {r.id for r in got} == {"a", "b", None}
