import hashlib
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from shelfscope.llm import best_fit as bf, piece_chunks as pc
from tests.conftest import SF

MODEL, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOK = Tokenizer.from_file(BPE)
TOK.encode_special_tokens = True
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t▁ab's<|é\u3000\x1c\x85")), max_size=60)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def pieces_row(text):
    ids = SP.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_marked_words_give_the_whole_segmentation(text):
    n, ids, decoded = pc._Texts(MODEL, []).joined([text])[0]
    whole = SP.encode(text)
    assert ids == " ".join(map(str, whole)) and n == len(whole) and decoded == SP.decode(whole)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_units_give_the_tokenizers_ids(text):
    assert np.frombuffer(bf.token_bytes(BPE, text), "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_op2_against_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op2_piece_encoding"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == pieces_row(docs[r.doc_id])


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_op2_odd_rows(spark, odd_docs, head):
    got = pc.encode_documents(odd_docs, MODEL, head_words=head).collect()
    want = [(r.doc_id, *pieces_row(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert pc.encode_documents(odd_docs.limit(0), MODEL).count() == 0


def check_packing(rows, docs, capacity):
    """Every document whole, every sequence gapless, and as many sequences as best-fit decreasing."""
    ids = {k: TOK.encode(t or "", add_special_tokens=False).ids + [0] for k, t in docs.items()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for k, part in pieces.items():
        at = 0
        for i, r in enumerate(sorted(part, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            data = np.array(ids[k][at: at + r.length], "<u4").tobytes()
            assert len(data) == 4 * r.length and zlib.crc32(data) == r.ids_crc32
            assert r.length == capacity or i == 0
            at += r.length
        assert at == len(ids[k])
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    gaps = []
    n = 0
    for length in sorted((r.length for r in rows), reverse=True):
        i = bisect_left(gaps, length)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        if gap > length:
            insort(gaps, gap - length)
    assert len(bins) <= n + 1


def test_op3_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(entry.queries()["op3_best_fit_packing"](spark, SF).collect(), docs, 2048)


def test_op3_odd_rows(spark, odd_docs):
    unique = odd_docs.dropDuplicates(["doc_id"])
    for capacity in (1, 7, 64):
        rows = bf.pack_documents(unique, BPE, capacity).collect()
        check_packing(rows, {r.doc_id: r.text for r in unique.collect()}, capacity)
    assert bf.pack_documents(odd_docs, BPE, 64).groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    assert bf.pack_documents(odd_docs.limit(0), BPE).count() == 0


def test_many_pieces_of_one_length(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "id as ids_crc32", "if(id % 3 = 0, 40L, 30L) as length")
    out = bf.pack(pieces, 100, ["doc_id", "piece", "ids_crc32"]).collect()
    used = defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
    # longest first: 834 pairs of 40, and three of 30 in each further sequence
    assert len(out) == 5000 and max(used.values()) <= 100 and len(used) <= 834 + 1111


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", " <|endoftext|> ", "<|endoftext", "  "])), max_size=6))
def test_added_tokens_give_the_unmodified_tokenizers_ids(parts):
    text = "".join(["a <|endoftext|> b", *parts])
    plain = Tokenizer.from_file(BPE)
    assert np.frombuffer(bf.token_bytes(BPE, text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
