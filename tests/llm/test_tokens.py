"""Encoding, decoding and packing against the tokenizer libraries themselves."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablecloak.llm import byte_bpe, packing, queries

TEXTS = ["", None, "plain words here", "tabs\tand  double  spaces \n next", "ümläut ß 中文字 🙂🙂 naïve", "  lead", "a" * 5000,
         "don't we'll I'd 123 4567", "<|endoftext|> as text", " \n \n ", "x \ny", "end ", "same text", "same text"]
SCHEMA = "doc_id bigint, text string, ids string, sequence_id string"


@pytest.fixture(scope="module")
def exact():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=byte_bpe.read_ranks(queries.RANKS))


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.rank_encoder(queries.RANKS, public_tokenizers.PATTERN)


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], SCHEMA)


@given(st.text(alphabet=st.sampled_from("ab éß中🙂 \n\t'1.,-<|>\x00"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_rank_library(exact, encoder, text):
    (at, ids, ends), = encoder.batches(pa.array([text]))
    assert (at, ends.tolist()) == (0, [0, len(ids)]) and ids.tolist() == exact.encode_ordinary(text)


def test_tokens_of_white_space_do_not_cross_chunks():
    """A vocabulary whose tokens of white space end in a space."""
    ranks = {bytes([b]): b for b in range(256)} | {b"\n ": 256, b"  ": 257, b"\t ": 258, b" z": 259}
    own = byte_bpe.Encoder(byte_bpe.tokenizer_of_ranks(ranks, r"\s+|\S+"))
    plain = byte_bpe.Encoder(byte_bpe.tokenizer_of_ranks(ranks, byte_bpe.BUILT_IN))
    for encoder in (plain, own):
        for texts in (["x a\n", None, "z q"], ["", "a\n", "b\t", "a", "c d\n"], ["\n", "\t", "x"]):
            if encoder is own and any(" " in (t or "") for t in texts):
                continue  # that pattern lets white space and what follows apart, but joins runs of it
            for at, ids, ends in encoder.batches(pa.array(texts, pa.string())):
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    assert ids[a:b].tolist() == encoder.tokenizer.encode(texts[at + k] or "", add_special_tokens=False).ids


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_round_trip_and_offsets(encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    table = encoder.table
    (_, ids, _), = encoder.batches(pa.array([text]))
    assert byte_bpe.decode_bytes(ids, table) == text.encode()
    assert "".join(byte_bpe.decode_pieces([[i] for i in ids.tolist()], table)) == text
    starts, ends = byte_bpe.character_offsets(ids, table)
    for i, a, b in zip(ids.tolist(), starts, ends):
        assert table[i] in text[a:b].encode() and len(text[a:b].encode()) - len(table[i]) <= 6
    assert not len(ids) or (starts[0] == 0 and ends[-1] == len(text))


def test_byte_characters_are_distinct_and_visible():
    char = byte_bpe.byte_characters()
    assert len(set(char)) == 256 and all(not c.isspace() for c in char) and char[65] == "A"


def test_portions_and_rows(encoder, exact, monkeypatch):
    for name, value in (("PORTION", 50), ("ROWS", 3), ("JOINED", 2)):
        monkeypatch.setattr(byte_bpe, name, value)
    texts = [t for t in TEXTS for _ in range(2)]
    found = []
    for at, ids, ends in encoder.batches(pa.array(texts).slice(1)):
        assert at == len(found)
        found += [x.tolist() for x in np.split(ids, ends[1:-1])]
    assert found == [exact.encode_ordinary(t or "") for t in texts[1:]]


def test_another_pattern():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(queries.RANKS)
    pattern = r" ?[A-Za-z]+| ?[^\sA-Za-z]+|\s+(?!\S)|\s+"
    exact = tiktoken.Encoding("own", pat_str=pattern, special_tokens={}, mergeable_ranks=ranks)
    own = byte_bpe.Encoder(byte_bpe.tokenizer_of_ranks(ranks, pattern))
    (_, ids, _), = own.batches(pa.array(["some é words 12 of\ttext"]))
    assert ids.tolist() == exact.encode_ordinary("some é words 12 of\ttext")


def test_digests_of_odd_rows(odd, exact):
    got = {r.doc_id: r for r in byte_bpe.round_trip_digests(odd, queries.RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = exact.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode(odd):
    tokens = byte_bpe.encode(odd, queries.RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(tokens, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_invalid_bytes_become_a_replacement(encoder):
    table = encoder.table
    lone = next(i for i, b in enumerate(table) if b == b"\xf0")
    assert "".join(byte_bpe.decode_pieces([[lone], [table.index(b"a")]], table)) == "�a"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.round_trip_digests(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, queries.TOKENIZER).count() == 0


def check_pieces(rows, texts):
    """Every id lies in one piece, sequences have no gaps, and only powers of two lack padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at and r.sequence_length == members[0].sequence_length
            at += r.length
        assert at == members[0].sequence_length <= packing.CONTEXT and at & (at - 1) == 0
    return sequences


def test_pieces_of_odd_rows(odd):
    check_pieces(packing.pack(odd, queries.TOKENIZER).collect(), dict(enumerate(TEXTS)))


def test_pieces_of_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sequences = check_pieces(queries.op9(spark, "/root/testdata/sf0.001").collect(), texts)
    long = sum(m[0].sequence_length == packing.CONTEXT for m in sequences.values())
    assert long * packing.CONTEXT >= 0.9 * sum(m[0].sequence_length for m in sequences.values())


@given(st.lists(st.integers(1, 5000), max_size=60))
@settings(max_examples=50, deadline=None)
def test_packer_loses_nothing(sizes):
    packer = packing.TierPacker()
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.close()
    found = defaultdict(list)
    for size, pieces in packer.ready:
        assert sum(len(p.ids) for p in pieces) == size
        for p in pieces:
            found[p.doc].extend(range(p.start, p.start + len(p.ids)))
            assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids)))
    assert {i: sorted(x) for i, x in found.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_step_groups_are_even():
    costs = [k * k for k in range(1, 65)]
    groups = packing.balanced_groups(costs, 8)
    sums = [sum(c for c, g in zip(costs, groups) if g == k) for k in range(8)]
    assert max(sums) < 1.1 * min(sums) and all(groups.count(k) == 8 for k in range(8))
