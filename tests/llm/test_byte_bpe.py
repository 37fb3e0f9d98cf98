"""Byte-level BPE against the library whose results it must give."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from poseframe.llm import byte_bpe
from poseframe.llm.byte_bpe import Encoder, Prefixes

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as f:
    LINES = f.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = Encoder(LINES, PATTERN)
VOCABULARY = OURS.vocabulary
TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="ab'sl t1\n é中!", max_size=60), st.text(alphabet="thequickanding", max_size=40))


def ids(text):
    return np.array(THEIRS.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_library_s_and_decode_back(text):
    assert OURS.encode(text) == ids(text)
    assert OURS.decode(ids(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_appended_text(text, more):
    assert OURS.appended(text, ids(text), more) == ids(text + more)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theinga", max_size=300), st.integers(0, 300), st.integers(0, 5), st.text(alphabet="thein", max_size=6))
def test_edits_of_a_piece(text, at, gone, new):
    at = min(at, len(text))
    gone = min(gone, len(text) - at)
    one = Prefixes(VOCABULARY, text.encode())
    one.replace(at, at + gone, new.encode())
    other = Prefixes(VOCABULARY, (text[:at] + new + text[at + gone :]).encode())
    assert (one.data, one.last, one.tokens()) == (other.data, other.last, other.tokens())


def test_an_edit_works_out_few_prefixes():
    one = Prefixes(VOCABULARY, b"international" * 2000)
    assert one.replace(5000, 5001, b"x") < 6 * VOCABULARY.longest


def test_pairs_stand_if_they_encode_to_themselves():
    rng = np.random.default_rng(5)
    some = [int(x) for x in rng.integers(0, 2000, 4000)]
    for a, b in zip(some[::2], some[1::2], strict=True):
        joined = VOCABULARY.token[a] + VOCABULARY.token[b]
        assert VOCABULARY.judge(a, b) == (VOCABULARY.merged(joined) == [a, b])
    for a in range(256, 1500):  # equal neighbours, where the leftmost merge comes first
        assert VOCABULARY.judge(a, a) == (VOCABULARY.merged(VOCABULARY.token[a] * 2) == [a, a])


def test_every_token_encodes_to_itself():
    assert all(VOCABULARY.merged(t) == [i] for t, i in RANKS.items() if len(t) < 16)


@pytest.mark.parametrize("text", ["a" * 30000, "the" * 9000, "中文" * 4000, " " * 20000 + "x", "one two\n" * 30000, "9" * 5000])
def test_long_texts(text):
    assert OURS.encode(text) == ids(text)


def test_query_over_documents_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in byte_bpe.round_trip(docs, PATH, PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(r["doc_id"], len(ids(r["text"] or "")) // 4, sha(ids(r["text"] or "")), sha((r["text"] or "").encode())) for r in docs.collect()}
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", "z"), (2, "a b", "z"), (3, "<|endoftext|>" * 20000, "ids")], "doc_id long, text string, ids string")
    rows = byte_bpe.encoded(odd, PATH, PATTERN)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]) == ids({1: "", 2: "a b", 3: "<|endoftext|>" * 20000}.get(r["doc_id"], ""))) for r in rows.collect()) == [
        (0, 0, True), (1, 0, True), (2, 2, True), (2, 2, True), (3, len(ids("<|endoftext|>" * 20000)) // 4, True)
    ]
    assert {bytes(r["bytes"]) for r in byte_bpe.decoded(rows, PATH, PATTERN).collect()} == {b"", b"a b", b"<|endoftext|>" * 20000}
    more = rows.where("doc_id = 2").selectExpr("doc_id", "'a b' AS text", "ids", "'cd e' AS more")
    assert {bytes(r["ids"]) for r in byte_bpe.extended(more, PATH, PATTERN).collect()} == {ids("a bcd e")}
    assert byte_bpe.round_trip(docs.where("false"), PATH, PATTERN).count() == 0
