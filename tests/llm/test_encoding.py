"""Ids equal those of the public library; boundaries equal the pattern; round trips."""

import os

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skylattice.llm.encoding import FOLDER, PairMerger, decode_ids, encode_corpus, encode_texts, portions, read_ranks
from skylattice.llm.pretokens import slices

pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tokenizer files")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ODD = ["", " ", "\n", "'s", "it's", "''s", " 's", "'sx", "'LL", "a  b", "a \n b", "　中文 字", "x" * 3000 + "'ll", "12 34½", "  a", "\x1c\x85", "<|endoftext|>", "👩‍🔧 ok", "é", "\x00\x00", "٣٤ ب", "'" * 50, " " * 999]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def merge():
    return PairMerger(read_ranks())


def pieces(text):
    data, a, b, _, _ = slices([text])
    return [data[x:y].decode() for x, y in zip(a, b)]


@given(st.lists(st.sampled_from([*"'strevmld ", "'s", "'ll", "  ", "\n", "　", "é", "中", "1", "½", "!", "́", "퟿", "\U0001f600"]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_boundaries_equal_the_pattern(text):
    assert pieces(text) == [m[0] for m in PATTERN.finditer(text)]


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(library, merge, texts):
    ids, n, offset, per_slice, per_text = encode_texts(texts, merge)
    at = 0
    for text, k in zip(texts, n):
        assert ids[at : at + k].tolist() == library.encode(text, add_special_tokens=False).ids
        at += k
    assert per_slice.sum() == len(ids) and per_text.sum() == len(offset)


def test_corpus(spark, library):
    rows = [(i, t, i, [9]) for i, t in enumerate([*ODD, None, *ODD[:3]])] + [(None, "no id", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, starts array<int>")
    out = encode_corpus(df, offsets=True).collect()
    assert len(out) == len(rows)
    ranks = read_ranks()
    by = {r.doc_id: r for r in out}
    for i, t, _, _ in rows:
        r = by[i]
        assert r.ids == library.encode(t or "", add_special_tokens=False).ids
        assert decode_ids(r.ids, ranks) == (t or "")
        at = 0
        for k, (s, c) in enumerate(zip(r.starts, r.counts)):  # each pre-token's place
            end = r.starts[k + 1] if k + 1 < len(r.starts) else len(t)
            assert decode_ids(r.ids[at : at + c], ranks) == t[s:end]
            at += c
    assert by[ODD.index("")].ids == [] and by[len(ODD)].ids == []
    assert encode_corpus(df.limit(0)).count() == 0


def test_long_slices_merge_the_same(merge):
    for word in (b"abc" * 200, "日本語".encode() * 60, b"0" * 500, b"the cat".replace(b" ", b"") * 90):
        assert merge._few(word) == merge._many(word)


def test_portions_cover_all():
    texts = ["a" * 10] * 7 + [None, "b" * 100, ""]
    assert [x for lo, hi in portions(texts, 25) for x in range(lo, hi)] == list(range(10))
