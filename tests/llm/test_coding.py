"""Token ids, token counts and byte-pair coding against the library and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pulseframe.llm import bpe, token_planes, wordpiece
from pulseframe.llm.common import shared_path

TRICKY = ["", "İstanbul ΣΑΣ Σ. it's don't We'LL x\x1cy   z 12345 ½ Ⅷ é ẞ", "a  b   c\n d\n\n e\t f <|endoftext|> <|endoftext|>x foo<|startoftext|>",
          "  lead", " x", "trail ", "\n", "日本語 텍스트 😀👍🏽 mixed!!!...###", "é    x\u0085y"]
letters = st.text(alphabet=st.sampled_from(list("abz'st é Éß\n\t .,!12Σσİ😀 ́<|>")), max_size=60)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def by_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(letters)
def test_word_bpe_is_the_librarys(text):
    model = bpe.load(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json")) if not hasattr(test_word_bpe_is_the_librarys, "t") else test_word_bpe_is_the_librarys.t
    test_word_bpe_is_the_librarys.t = library
    assert model.encode(text) == by_library(library, text)


@settings(max_examples=300, deadline=None)
@given(letters)
def test_words_of_the_byte_vocabulary_join_to_the_whole(text):
    coder = token_planes.load(P.path("byte_bpe_50k.json"))
    assert coder.encode(text) == np.array(coder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_decode_gives_the_encoders_strings(word_library):
    model = bpe.load(P.path("word_bpe_49k.json"))
    for text in TRICKY:
        ids, decoded = model.encode(text)
        assert (ids, decoded) == by_library(word_library, text)
        assert model.decode(ids) == decoded


def test_merges_skip_stale_entries():
    # a b c: (b, c) ranks before (a, b); after it, (a, b) is stale.
    merges = bpe.MergeList([(1, 2, 10), (0, 1, 11), (0, 10, 12)])
    assert merges.apply([0, 1, 2]) == [12]
    assert merges.apply([0, 1, 0, 1, 2, 2]) == [11, 12, 2]
    assert merges.apply([]) == [] and merges.apply([5]) == [5]


def test_bpe_on_messy_rows(spark, messy, word_library):
    rows = bpe.digests(bpe.encode_decode(messy, P.path("word_bpe_49k.json"))).collect()
    expected = []
    for r in messy.select("doc_id", "text").collect():
        ids, decoded = by_library(word_library, r.text or "")
        expected.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert bpe.encode_decode(messy.limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("planes", [token_planes.BYTE, token_planes.BIT])
def test_planes_there_and_back(planes):
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2 ** 32, n, dtype=np.uint32)
        assert (token_planes.unpack_block(token_planes.pack_block(ids, planes)) == ids).all()


@pytest.mark.parametrize("planes", [token_planes.BYTE, token_planes.BIT])
def test_shards_hold_every_document_in_order(spark, messy, planes):
    path, model = shared_path(spark, "t"), P.path("byte_bpe_50k.json")
    token_planes.write_ids(messy, f"{path}/s", model, planes=planes, block_ids=1000)
    index = token_planes.write_index(spark, f"{path}/s", f"{path}/i")
    rows = token_planes.read_documents(spark, f"{path}/s", index).collect()
    library = token_planes.load(model).library
    table = sorted(messy.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start, expected = 0, []
    for r in table:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in rows) == [(s, k, n, c) for k, s, n, c in expected]
    assert index.selectExpr("sum(n_ids)").first()[0] == start
    assert index.where("n_ids > 1000").isEmpty()


def test_no_documents_no_shards(spark, messy):
    path = shared_path(spark, "t")
    token_planes.write_ids(messy.limit(0), f"{path}/s", P.path("byte_bpe_50k.json"))
    index = token_planes.write_index(spark, f"{path}/s", f"{path}/i")
    assert token_planes.read_documents(spark, f"{path}/s", index).count() == 0


def greedy(word, first, later, longest):
    n, i = 0, 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in (first if i == 0 else later):
                break
        else:
            return -1
        n, i = n + 1, j
    return n


@settings(max_examples=500, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5)), st.sets(st.text(alphabet="abc", min_size=1, max_size=5)), st.text(alphabet="abc", max_size=14))
def test_automaton_counts_greedy_pieces(first, later, word):
    assert wordpiece.PieceCounter(list(first), list(later)).count(word) == greedy(word, first, later, 5)


def test_pieces_of_messy_rows(spark, messy):
    first, later = map(set, wordpiece.sentence_pieces(P.path("piece_bpe_32k.model")))
    longest = max(map(len, first | later))
    rows = wordpiece.count_pieces(messy, P.path("piece_bpe_32k.model")).collect()
    expected = []
    for r in messy.select("doc_id", "text").collect():
        counts = [greedy(w, first, later, longest) for w in (r.text or "").split()]
        expected.append((r.doc_id, len(counts), sum(1 if c < 0 else c for c in counts), counts.count(-1)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert wordpiece.count_pieces(messy.limit(0), P.path("piece_bpe_32k.model")).count() == 0
