"""BPE and token blocks against the public libraries."""

import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import _text, byte_bpe, token_files

RANKS = P.path(byte_bpe.RANKS)
VOCABULARY = P.path(token_files.VOCABULARY)
ODD = [
    "", " ", "  a", "a  ", "a \n b", "don't we'll 're x'sy ''s 's's'", "\n\n a", "\t\tb", "1 2  33 a1b2", "' s", "　　z", "a" * 3000, "日本語 テスト", "🙂🙂 ok", "͸ odd",
    "a\x1cb", "'re've'll'lx", "\r\n\r\n x", "<|endoftext|> x", "é à Ñ", "ab " * 5000, "\x00\x01", "é x​y",
]


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_bpe_equals_the_library(reference):
    for text, ids in zip(ODD, byte_bpe.encode(ODD, RANKS), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), repr(text[:40])
        assert byte_bpe.decode(ids, RANKS) == text.encode()


def test_long_texts_are_cut_without_effect(reference, monkeypatch):
    texts = ["one two  three\n four's " * 200, "", "x" * 500, "tail"]
    monkeypatch.setattr(_text.chunks, "__defaults__", (100,))
    assert [x.tolist() for x in byte_bpe.encode(texts, RANKS)] == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinorst THELing'.,!?12\n\t éñß日🙂 ")), max_size=60))
def test_bpe_on_random_texts(text):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}) if not hasattr(test_bpe_on_random_texts, "own") else test_bpe_on_random_texts.own
    test_bpe_on_random_texts.own = reference
    assert next(byte_bpe.encode([text], RANKS)).tolist() == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_pieces_equal_the_pattern(text):
    kinds = _text.classes()
    _, codes, bounds = _text.points([text])
    if not len(codes) or (kinds[codes] == _text.ODD).any():
        return
    start = _text.piece_starts(codes, bounds)
    ends = [*start[1:].tolist(), len(text)]
    assert [text[a:b] for a, b in zip(start.tolist(), ends, strict=True)] == regex.findall(P.PATTERN, text)


def test_encode_documents(spark, reference):
    import hashlib

    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = byte_bpe.encode_documents(df, RANKS).collect()
    assert len(made) == len(rows)
    digests = {r.doc_id: r for r in byte_bpe.encode_documents(df, RANKS, digests=True).collect()}
    for r in made:
        ids = reference.encode_ordinary(rows[r.doc_id][1] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(bytes(r["ids"])).hexdigest()
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()


def test_perfect_hash_is_minimal_and_refuses_foreign_keys():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(-(2**60), 2**60, 5000))
    made = token_files.PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    block = token_files.Block(token_files._block(0, 0, 0, keys.tolist(), [np.array([k % 7, 1], np.uint32) for k in range(len(keys))]))
    for i in (0, 17, len(keys) - 1):
        assert [x.tolist() for x in block.get(int(keys[i]))] == [[i % 7, 1]]
    assert sum(bool(block.get(int(k))) for k in range(10_000)) <= 1


def test_token_files_round_trip(spark, library, tmp_path):
    rows = [(i * 3 % 101, t, 1) for i, t in enumerate([*ODD, None])] + [(5, "again", 1), (5, "and again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = str(tmp_path / "blocks")
    token_files.write_tokens(df, VOCABULARY, out)
    made = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in made] == sorted(r[0] for r in rows)
    at = 0
    for r in made:
        assert r.start == at
        at += r.n_tokens
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    for i, want in by_id.items():
        assert sorted(r.ids_crc32 for r in made if r.doc_id == i) == sorted(map(crc, want))
        assert sorted(x.tolist() for x in token_files.get(spark, out, i)) == sorted(want)
    assert token_files.get(spark, out, 10**6) == []


def test_token_files_query_equals_the_library_as_loaded(spark, tmp_path):
    texts = ["one two " * 150_000 + "<|endoftext|> three", *ODD, "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a <|endoftext| > b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    loaded = Tokenizer.from_file(VOCABULARY)
    made = {r.doc_id: r for r in token_files.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = [*loaded.encode(t, add_special_tokens=False).ids, 0]
        assert (made[i].n_tokens, made[i].ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), repr(t[:40])


def test_small_blocks_keep_documents_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_KEYS", 2)
    keys = list(range(9))
    made = [token_files._block(0, n, 3 * n, keys[n : n + 2], [np.arange(3, dtype=np.uint32)] * len(keys[n : n + 2])) for n in range(0, 9, 2)]
    assert [m["n_docs"] for m in made] == [2, 2, 2, 2, 1]


def test_a_key_with_many_rows_goes_on_in_other_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_KEYS", 4)
    rows = [(7, f"text {i}") for i in range(20)] + [(None, "none"), (None, None), (9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = str(tmp_path / "hot")
    token_files.write_tokens(df, VOCABULARY, out)
    blocks = spark.read.parquet(out).select("n_docs").collect()
    assert sum(r.n_docs for r in blocks) == len(rows) and len(token_files.get(spark, out, 7)) == 20
    made = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in made] == [None] * 2 + [7] * 20 + [9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(made, made[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), max_size=6))
def test_index_equals_a_dictionary(groups):
    made, want = _text.Index(2), {}
    for group in groups:
        new = np.array([h for h in group if h not in want], np.uint64)
        made.add(new)
        for h in new.tolist():
            want[h] = len(want)
        asked = np.array([*want, *(h ^ 1 for h in want)], np.uint64)
        assert made.find(asked).tolist() == [want.get(int(h), -1) for h in asked]


def test_pieces_survive_new_tables():
    table = _text.PieceTable(lambda xs: [[ord(c) for c in x] for x in xs], limit=3)
    for text in ["a b c", "d e f", "a b d", "g", "a f g e d c b a" * 3]:
        ids, _ = table.ids([text])
        assert "".join(map(chr, ids)) == text


def test_token_files_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(df, VOCABULARY, str(tmp_path / "none"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0
