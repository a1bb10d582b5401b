"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

A byte-level tokenizer sees every byte as one visible character (`byte_characters`), so its
vocabulary is text. Ranks of byte strings are turned into such a vocabulary; decoding maps the
characters back to bytes, where a token may hold a part of a UTF-8 character only.

Edge cases: a null text is an empty text; an empty text has no ids and decodes to nothing;
repeated rows are encoded each on their own; columns besides the named ones are ignored, so
clashing names do no harm; an empty table gives an empty result; a text of any length is encoded
whole (it is held by one task, as Spark holds a string value).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablecloak.llm.common import ship

#: Bytes of text whose chunks are looked up together, and rows whose ids are laid out at once.
PORTION, ROWS = 32 << 20, 256
#: Chunks that are encoded in one call.
JOINED = 2000
#: Fixed value: the pattern that the library's own byte-level splitter has.
BUILT_IN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space (of Unicode, and the separators) before a space.
_UNSAFE = (r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ")
#: An empty chunk, or one that ends in white space.
_ENDING = r"(?:^|[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])\z"

_LOADED: dict[tuple, "Encoder"] = {}


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 stands for itself,
    every other byte for the next free character from 256 on."""
    own = {b for first, last in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(first, last + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in f if x.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A byte-level tokenizer that merges, as ranks ask for, the pair whose join ranks lowest; every
    split of a token into two tokens is therefore a merge of that token's rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    char = byte_characters()
    shown = {token: "".join(char[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        pairs = ((token[:k], token[k:]) for k in range(1, len(token)))
        merges.extend((shown[a], shown[b]) for a, b in pairs if a in ranks and b in ranks)
    tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges,
                                     ignore_merges=True))
    if pattern == BUILT_IN:
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    else:
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class Encoder:
    """Encodes whole texts of Arrow batches; every distinct chunk of a batch is encoded once.

    A chunk is a space with what follows up to the next space. Where no white space stands before a
    space, no match of the pattern crosses the start of a chunk, so a text's ids are those of its
    chunks. Distinct chunks are encoded many at a time, as one text, and cut by the bytes of the
    tokens; those that are empty or end in white space, which only end a text, are encoded one by one, as are texts
    with white space before a space."""

    def __init__(self, tokenizer):
        tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.tokenizer = tokenizer
        self.table = token_bytes(tokenizer)
        self.lengths = np.array([len(x) for x in self.table], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, where each chunk's begin, and their count."""
        last = pc.match_substring_regex(chunks, _ENDING).to_numpy(zero_copy_only=False)
        joined, lone = chunks.filter(pa.array(~last)), chunks.filter(pa.array(last))
        ids = [np.zeros(0, "<u4")]
        for k in range(0, len(joined), JOINED):
            ids += self.ids([" " + " ".join(joined.slice(k, JOINED).to_pylist())])
        ids = np.concatenate(ids)
        ends = np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")
        alone = self.ids([" " + x for x in lone.to_pylist()])
        counts = np.zeros(len(chunks), np.int64)
        starts = np.zeros(len(chunks), np.int64)
        counts[~last] = np.diff(at, prepend=0)
        starts[~last] = np.concatenate(([0], at))[:len(at)]
        counts[last] = [len(x) for x in alone]
        starts[last] = len(ids) + np.cumsum(counts[last]) - counts[last]
        return np.concatenate((ids, *alone)), starts, counts

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of rows: the first row, the ids of all, and where each row's begin and end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + PORTION, "right")))
            yield from ((at + k, ids, ends) for k, ids, ends in self._portion(texts.slice(at, end - at)))
            at = end
        pa.default_memory_pool().release_unused()  # workers live on and share an executor's memory

    def _portion(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        alone = pc.match_substring_regex(texts, _UNSAFE)
        parts = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        dictionary, known = coded.dictionary, len(coded.dictionary)
        del parts, coded  # as large as the texts, and done with
        ids, starts, counts = self._chunks(dictionary)
        # a text's first chunk has no space before it, and some texts are one chunk
        first = dictionary.take(pa.array(codes[bounds[:-1]])).to_pylist()
        whole = alone.to_pylist()
        heads = self.ids([t.as_py() if w else f for t, w, f in zip(texts, whole, first)])
        starts = np.concatenate((starts, len(ids) + np.cumsum([0] + [len(h) for h in heads[:-1]])))
        counts = np.concatenate((counts, [len(h) for h in heads]))
        ids = np.concatenate((ids, *heads)).astype("<u4")
        codes[bounds[:-1]] = known + np.arange(len(texts))
        for k in range(0, len(texts), ROWS):
            mine = bounds[k:min(k + ROWS, len(texts)) + 1]
            part = codes[mine[0]:mine[-1]]
            n = counts[part]
            ends = np.concatenate(([0], np.cumsum(n)))
            out = ids[np.repeat(starts[part] - ends[:-1], n) + np.arange(ends[-1])]
            yield k, out, ends[mine - mine[0]]


def rank_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, loaded once by each Python worker."""
    key = ("ranks", path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Encoder(tokenizer_of_ranks(read_ranks(path), pattern))
    return _LOADED[key]


def file_encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once by each Python worker."""
    from tokenizers import Tokenizer

    key = ("file", path)
    if key not in _LOADED:
        _LOADED[key] = Encoder(Tokenizer.from_file(path))
    return _LOADED[key]


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id: the character table, reversed."""
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(back[c] for c in token)
    return out


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode_rows(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> Iterator[memoryview]:
    """Bytes of rows of ids that lie one after another."""
    taken = table.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:][ends]
    data = memoryview(taken.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(at, at[1:]))


def character_offsets(ids: np.ndarray, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters. A character split over several tokens belongs to
    each of them."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(decode_bytes(ids, table), np.uint8)
    ends = np.cumsum([len(table[i]) for i in ids.tolist()])
    starts = np.concatenate(([0], ends[:-1]))
    opened = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before a byte
    split = np.concatenate(((data & 0xC0) == 0x80, [False]))
    return opened[starts] - split[starts], opened[ends]


def decode_pieces(pieces: Iterable[list[int]], table: list[bytes]) -> Iterator[str]:
    """Text of a stream of ids; bytes of an unfinished character wait for the next piece, and what is
    no UTF-8 becomes U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in pieces:
        yield decoder.decode(decode_bytes(np.asarray(ids, np.int64), table))
    yield decoder.decode(b"", True)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, ids, starts, ends`: ids of the whole text and the characters that each token covers."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import byte_bpe as b

        encoder = b.rank_encoder(path, pattern)
        for batch in batches:
            for at, found, ends in encoder.batches(batch.column(1)):
                part = batch.slice(at, len(ends) - 1)
                ids = np.split(found, ends[1:-1])
                spans = [b.character_offsets(x, encoder.table) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                     pa.array([s for s, _ in spans], pa.list_(pa.int64())),
                     pa.array([e for _, e in spans], pa.list_(pa.int64()))], [key, "ids", "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, ids array<int>, starts array<bigint>, ends array<bigint>")


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key, text`: ids back to text, as one stream per row."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import byte_bpe as b

        table = b.rank_encoder(path, pattern).table
        for batch in batches:
            texts = ["".join(b.decode_pieces([x or []], table)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """`key, n_tokens, ids_sha256, decoded_sha256`: each text encoded and decoded within one task, so
    that the ids need not be moved."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import byte_bpe as b

        encoder = b.rank_encoder(path, pattern)
        table = pa.array(encoder.table, pa.large_binary())
        for batch in batches:
            for at, ids, ends in encoder.batches(batch.column(1)):
                encoded = [hashlib.sha256(x).hexdigest() for x in np.split(ids, ends[1:-1])]
                decoded = [hashlib.sha256(x).hexdigest() for x in b.decode_rows(ids, ends, table)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(encoded)), pa.array(np.diff(ends)), pa.array(encoded, pa.string()),
                     pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
