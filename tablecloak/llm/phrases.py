"""Phrase collocations from FM-indexes over word ids.

Texts become pieces (cut at SEPARATORS) of words. Each task gathers the pieces of a language into shards of
about SHARD_WORDS words, numbered by a dictionary of their own, with 0 between pieces. A shard is indexed in both
directions: rows sorted by their next DEPTH symbols, the column before them (the Burrows-Wheeler
transform, of limited context), and the rows of every symbol. A phrase is an interval of rows; those of all
phrases of a depth are extended to the left together, and the interval in the reversed text follows, so that each
phrase has its count and how many occurrences go on to the left and to the right within their pieces.
Counts are summed across shards.

Not every phrase of a shard can be sent round, so a first round finds words and pairs that are frequent
in the whole corpus: shards send hashes of theirs with counts, by ranges of the hash, and get back one bit for each. A
phrase of more words is only extended to while all its pairs are frequent, which every frequent phrase
fulfils. Equal hashes of different pairs let too much through, never too little, and the sums of the second
round, which shards send by ranges as well, are over the words themselves.

A piece of any length may be cut between two shards: the second begins with the last DEPTH - 1 words of the
first, and what lies in these words alone is subtracted by a shard of sign -1.

Edge cases: null, empty and blank texts have no words; a null language is `und`; ties are ordered by phrase;
repeated rows count each; other columns are ignored, so clashing names do no harm; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecloak.llm import near_dup
from tablecloak.llm.common import Scratch, ship

DEPTH = 4
MIN_COUNT = 30
#: Phrases within a longer one that has this share (in a hundred) of their count are dropped.
WITHIN = 80
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
#: Words of a shard, and the bits that number its rows and its words (a shard may exceed the first by a part of a text).
SHARD_WORDS = 1 << 20
ROW_BITS = 21
#: Hashes whose counts are summed in one task.
RANGE_KEYS = 1 << 20
#: Parts that the phrases of a language are ranked in before they meet.
SALTS = 16

_U = np.uint64
_MASK = _U((1 << ROW_BITS) - 1)
_LOWER = near_dup._LOWER
#: Bytes of a word, between words, and between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


def cut(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of texts that lie one after another, in parts, and which of them begin a piece."""
    last, seen = -1, 0
    for a, b in near_dup._parts(data):
        kind = _KIND[data[a:b]]
        word = kind == 0
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inside = offsets[(offsets >= a) & (offsets < b)] - a
        begin[inside] |= word[inside]
        starts = np.flatnonzero(begin)
        marks = np.flatnonzero(kind == 2)
        piece = seen + np.searchsorted(marks, starts) + np.searchsorted(offsets, starts + a, "right")
        seen += len(marks)
        if len(starts):
            ends = np.add.reduceat(word, starts, dtype=np.int64)  # the bytes of a word up to the next start
            body = _LOWER[data[a:b][word]]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
                None, pa.py_buffer(np.concatenate(([0], np.cumsum(ends)))), pa.py_buffer(body)])
            yield words, np.diff(piece, prepend=last) != 0
            last = piece[-1]


def squeezed(data: bytes) -> bytes:
    """Bytes with their length before them, compressed."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(ids: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, of which the upper ones compress well."""
    return squeezed(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def of_planes(data: bytes) -> np.ndarray:
    own = np.frombuffer(unsqueezed(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(own.T).view("<u4").ravel().astype(np.uint64)


@dataclass
class Gathered:
    """Words of a language that wait for their shard."""

    words: list[pa.Array] = field(default_factory=list)
    breaks: list[np.ndarray] = field(default_factory=list)
    n: int = 0
    tail: pa.Array | None = None

    def add(self, words: pa.Array, breaks: np.ndarray) -> pa.Array | None:
        """Takes words; gives those that the shard before has as well, if one of its pieces goes on."""
        twice = None
        if not self.n and not breaks[0] and self.tail is not None:
            twice = self.tail
            self.words.append(twice)
            self.breaks.append(np.arange(len(twice)) == 0)
            self.n += len(twice)
        self.words.append(words)
        self.breaks.append(breaks)
        self.n += len(words)
        return twice

    def shard(self) -> tuple[pa.Array, np.ndarray, int]:
        """Dictionary, numbered pieces and number of words; what follows begins a new shard."""
        words, breaks = pa.concat_arrays(self.words), np.concatenate(self.breaks)
        own = len(words) - np.flatnonzero(breaks)[-1] if breaks.any() else len(words)
        self.tail = words.slice(len(words) - min(own, DEPTH - 1))
        self.words, self.breaks, self.n = [], [], 0
        return (*numbered(words, breaks), len(words))


def numbered(words: pa.Array, breaks: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the text as their numbers from 1, with 0 before each piece."""
    coded = words.dictionary_encode()
    breaks = breaks.copy()
    breaks[0] = True
    ids = np.zeros(len(words) + int(breaks.sum()), np.int64)
    ids[np.arange(len(words)) + np.cumsum(breaks)] = coded.indices.to_numpy() + 1
    return coded.dictionary.cast(pa.large_string()).cast(pa.string()), ids


def shards(docs: DataFrame, text: str, lang: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`shard, lang, sign, n_words, words, ids`."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tablecloak.llm import near_dup as n
        from tablecloak.llm import phrases as p

        task, made = TaskContext.get().partitionId(), 0
        waiting: dict[str, p.Gathered] = {}

        def row(name: str, sign: int, words: pa.Array, ids: np.ndarray, count: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 33) + made]), pa.array([name]), pa.array([sign], pa.int32()), pa.array([count]),
                 pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([p.planes(ids)])],
                ["shard", "lang", "sign", "n_words", "words", "ids"])

        for batch in batches:
            coded = pc.fill_null(batch.column(1), p.UNKNOWN).dictionary_encode()
            for k, name in enumerate(coded.dictionary.to_pylist()):
                mine = batch.column(0).filter(pc.equal(coded.indices, k))
                for _, data, offsets in n.text_chunks(mine):
                    for words, breaks in p.cut(data, offsets):
                        gathered = waiting.setdefault(name, p.Gathered())
                        twice = gathered.add(words, breaks)
                        if twice is not None:
                            yield row(name, -1, *p.numbered(twice, np.zeros(len(twice), bool)), len(twice))
                        if gathered.n >= shard_words:
                            yield row(name, 1, *gathered.shard())
            while sum(g.n for g in waiting.values()) >= 2 * shard_words:  # many languages wait
                name = max(waiting, key=lambda x: waiting[x].n)
                yield row(name, 1, *waiting[name].shard())
        for name, gathered in waiting.items():
            if gathered.n:
                yield row(name, 1, *gathered.shard())

    return docs.select(text, lang).mapInArrow(
        run, "shard bigint, lang string, sign int, n_words bigint, words array<string>, ids binary")


def word_hashes(lang: str, words: pa.Array) -> tuple[np.ndarray, np.uint64]:
    """Hashes of the words by their numbers, and that of the language."""
    import xxhash

    return (np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in words.to_pylist())], np.uint64),
            _U(xxhash.xxh3_64_intdigest(lang)))


def local_keys(lang: str, words: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and pairs of a shard in rising order, their counts, and what they stand for: a
    word's number, or those of a pair with the first in the upper bits."""
    each, own = word_hashes(lang, words)
    count = np.bincount(ids.astype(np.int64), minlength=len(each))[1:]
    pairs = ids[:-1] << _U(ROW_BITS) | ids[1:]
    pairs = np.sort(pairs[(ids[:-1] != 0) & (ids[1:] != 0)])
    new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    code = pairs[new]
    keys = np.concatenate((near_dup.mix(each[1:] ^ own), near_dup.mix(
        near_dup.mix(each[code >> _U(ROW_BITS)] + own) * near_dup._BASE + each[code & _MASK])))
    what = np.concatenate((np.arange(1, len(each), dtype=np.uint64), code))
    times = np.concatenate((count, np.diff(new, append=len(pairs))))
    order = np.argsort(keys, kind="stable")
    return keys[order], times[order], what[order]


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of hashes begins and ends among sorted ones."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << _U(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)])).astype(np.int32)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def frequent_bits(rows: DataFrame, bits: int, least: int) -> DataFrame:
    """`shard, part, mask`: for the words and pairs of each shard, in the order of `local_keys` and by ranges of
    the hash, whether all shards together hold them `least` times. Counts stop at 255."""
    least = min(least, 255)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import phrases as p

        for batch in batches:
            for k in range(batch.num_rows):
                keys, times, _ = p.local_keys(batch.column(1)[k].as_py(), batch.column(2)[k].values,
                                              p.of_planes(batch.column(3)[k].as_py()))
                ends = p._ranges(keys, bits)
                short = (keys >> _U(32 - bits)).astype("<u4")
                part = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), batch.column(0)[k].as_py())),
                     p._binaries(short, ends * 4).take(pa.array(part)),
                     p._binaries(np.minimum(times, 255).astype(np.uint8), ends).take(pa.array(part))],
                    ["part", "shard", "keys", "times"])

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = [np.frombuffer(x.as_buffer(), "<u4") for x in group["keys"]]
        every = np.concatenate(keys).astype(np.uint64)
        packed = np.sort(every << _U(32) | np.arange(len(every), dtype=np.uint64))
        place = (packed & _U(0xFFFFFFFF)).astype(np.int64)
        packed >>= _U(32)
        new = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        times = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in group["times"]])
        enough = np.add.reduceat(times[place].astype(np.int64), new) >= least
        out = np.zeros(len(every), bool)
        out[place] = np.repeat(enough, np.diff(new, append=len(every)))
        ends = np.cumsum([len(x) for x in keys])
        masks = [np.packbits(x).tobytes() for x in np.split(out, ends[:-1])]
        return pa.table({"shard": group["shard"], "part": group["part"], "mask": pa.array(masks, pa.binary())})

    sent = rows.select("shard", "lang", "words", "ids").mapInArrow(
        send, "part int, shard bigint, keys binary, times binary")
    return sent.groupBy("part").applyInArrow(meet, "shard bigint, part int, mask binary")


class Index:
    """The FM-index of a shard in both directions, for patterns of up to DEPTH words."""

    def __init__(self, ids: np.ndarray):
        if len(ids) >= 1 << ROW_BITS:
            raise ValueError("a shard is too long for its row numbers")
        self.size = len(ids)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(ids.astype(np.int64)))))
        self.column = self._transform(ids)
        rows = np.arange(self.size, dtype=np.uint64)
        self.places = np.sort(self.column << _U(ROW_BITS) | rows)  # rows of each symbol of the column
        self.goes_left = np.concatenate(([0], np.cumsum(self.column != 0)))
        self.goes_right = np.concatenate(([0], np.cumsum(self._transform(ids[::-1]) != 0)))

    def _transform(self, ids: np.ndarray) -> np.ndarray:
        """The symbol before each row, rows in the order of their next four symbols (the text is a ring)."""
        rows = np.arange(len(ids), dtype=np.uint64)
        pairs = np.sort((ids << _U(ROW_BITS) | np.roll(ids, -1)) << _U(ROW_BITS) | rows)
        new = np.concatenate(([False], (pairs[1:] >> _U(ROW_BITS)) != (pairs[:-1] >> _U(ROW_BITS))))
        rank = np.empty(len(ids), np.uint64)
        rank[(pairs & _MASK).astype(np.int64)] = np.cumsum(new)
        rows_by = np.sort((rank << _U(ROW_BITS) | np.roll(rank, -2)) << _U(ROW_BITS) | rows)
        return np.roll(ids, 1)[(rows_by & _MASK).astype(np.int64)]

    def words(self, chosen: np.ndarray) -> "Level":
        """Intervals of single words."""
        lo = self.below[chosen]
        return Level(chosen[:, None], lo, self.below[chosen + 1], lo)

    def extend(self, level: "Level", pairs: np.ndarray) -> "Level":
        """Intervals of all phrases with one word more on the left, whose first pair is among `pairs` (sorted)."""
        size = level.hi - level.lo
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        symbol = self.column[np.arange(len(group)) + np.repeat(level.lo - first, size)]
        found = np.sort(group.astype(np.uint64) << _U(ROW_BITS) | symbol)
        new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        times = np.diff(new, append=len(found))
        parent, symbol = (found[new] >> _U(ROW_BITS)).astype(np.int64), found[new] & _MASK
        kept = (symbol != 0) & among(symbol << _U(ROW_BITS) | level.ids[parent, 0].astype(np.uint64), pairs)
        new, times, parent, symbol = new[kept], times[kept], parent[kept], symbol[kept]
        lo = np.searchsorted(self.places, symbol << _U(ROW_BITS) | level.lo[parent].astype(np.uint64))
        # symbols before this one within the interval come before it in the reversed text
        back = level.back[parent] + new - first[parent]
        return Level(np.column_stack((symbol.astype(np.int64), level.ids[parent])), lo, lo + times, back)


@dataclass
class Level:
    """Phrases of one length: word numbers, interval of rows, and where that of the reversed text begins."""

    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    back: np.ndarray


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def packed_phrases(lang: str, words: pa.Array, levels: list, counts: list[np.ndarray], bits: int) -> pa.Table:
    """`part, lang, phrases, counts`: phrases (word numbers by length) by ranges of their hash; those of a range
    in order, as their neighbours compress well, with three counts each."""
    each, own = word_hashes(lang, words)
    texts, hashes = [], []
    for ids in levels:
        parts = [words.take(pa.array(ids[:, j] - 1)) for j in range(ids.shape[1])]
        texts.append(pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0])
        h = np.full(len(ids), own)
        for j in range(ids.shape[1]):
            h = near_dup.mix(h * near_dup._BASE + each[ids[:, j]])
        hashes.append(h >> _U(64 - bits) if bits else np.zeros(len(h), np.uint64))
    rows = pa.table({"part": pa.array(np.concatenate(hashes).astype(np.int32)), "text": pa.concat_arrays(texts)})
    order = pc.sort_indices(rows, [("part", "ascending"), ("text", "ascending")])
    part = rows["part"].take(order).to_numpy()
    text, counts = rows["text"].take(order).combine_chunks(), np.stack(counts)[:, order.to_numpy()]
    ends = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    blobs = [(int(part[a]), squeezed("\n".join(text[a:b].to_pylist()).encode()), squeezed(counts[:, a:b].tobytes()))
             for a, b in zip(ends, ends[1:])]
    return pa.table([pa.array([x[0] for x in blobs], pa.int32()), pa.repeat(pa.scalar(lang), len(blobs)),
                     *(pa.array([x[k] for x in blobs], pa.binary()) for k in (1, 2))], ["part", "lang", "phrases", "counts"])


def phrase_counts(rows: DataFrame, masks: DataFrame, bits: int, least: int, depth: int = DEPTH) -> DataFrame:
    """`lang, phrase, f, to_left, to_right`: from each shard the phrases of frequent words and pairs, summed; what
    occurs fewer than `least` times is left out."""
    def find(own: pa.Table, got: pa.Table) -> pa.Table:
        from tablecloak.llm import phrases as p

        own = own.combine_chunks()
        lang, sign = own["lang"][0].as_py(), own["sign"][0].as_py()
        words, ids = own["words"][0].values, p.of_planes(own["ids"][0].as_py())
        keys, _, what = p.local_keys(lang, words, ids)
        ends = p._ranges(keys, bits)
        frequent = np.zeros(len(keys), bool)
        for part, mask in zip(got["part"].to_pylist(), got["mask"].to_pylist()):
            n = ends[part + 1] - ends[part]
            frequent[ends[part]:ends[part + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=n)
        what = np.sort(what[frequent])
        split = np.searchsorted(what, _U(1 << ROW_BITS))
        pairs = what[split:]
        index = p.Index(ids)
        level = index.words(what[:split].astype(np.int64))
        levels, counts = [], []
        while len(level.lo):
            size = level.hi - level.lo
            levels.append(level.ids)
            counts.append(sign * np.stack((size, index.goes_left[level.hi] - index.goes_left[level.lo],
                                           index.goes_right[level.back + size] - index.goes_right[level.back])))
            if len(levels) == depth:
                break
            level = index.extend(level, pairs)
        if not levels:
            return pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()),
                              ("counts", pa.binary())]).empty_table()
        return p.packed_phrases(lang, words, levels, list(np.concatenate(counts, 1).astype("<i8")), bits)

    def add_up(group: pa.Table) -> pa.Table:
        from tablecloak.llm import phrases as p

        parts = []
        for row in group.to_pylist():
            text = pc.split_pattern(pa.array([p.unsqueezed(row["phrases"]).decode()]), "\n").values
            counts = np.frombuffer(p.unsqueezed(row["counts"]), "<i8").reshape(3, -1)
            parts.append(pa.table([pa.repeat(pa.scalar(row["lang"]), len(text)), text, *map(pa.array, counts)],
                                  ["lang", "phrase", "f", "to_left", "to_right"]))
        sums = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate(
            [(c, "sum") for c in ("f", "to_left", "to_right")])
        return sums.filter(pc.greater_equal(sums["f_sum"], least)).select(
            ["lang", "phrase", "f_sum", "to_left_sum", "to_right_sum"]).rename_columns(
                ["lang", "phrase", "f", "to_left", "to_right"])

    sent = (rows.select("shard", "lang", "sign", "words", "ids").groupBy("shard").cogroup(masks.groupBy("shard"))
            .applyInArrow(find, "part int, lang string, phrases binary, counts binary"))
    sums = sent.groupBy("part").applyInArrow(add_up, "lang string, phrase string, f bigint, to_left bigint, to_right bigint")
    return sums.withColumn("n_words", F.size(F.split("phrase", " ")))


def count_phrases(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", least: int = MIN_COUNT,
                  depth: int = DEPTH, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `depth` words that occur `least` times in their language, and `lang, n`: its words."""
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"phrases have one to {DEPTH} words")
    rows = scratch.keep(shards(docs, text, lang, shard_words))
    n = rows.groupBy("lang").agg(F.sum(F.col("sign") * F.col("n_words")).alias("n"))
    keys = rows.agg(F.sum(2 * F.col("n_words"))).first()[0] or 0
    bits = max(0, (int(keys) // RANGE_KEYS).bit_length())
    masks = scratch.keep(frequent_bits(rows, bits, least))
    found = scratch.keep(phrase_counts(rows, masks, bits, least, depth))
    return found, n


def scored(found: DataFrame, scale: int = SCALE) -> DataFrame:
    """`lang, phrase, a, l, r, score, to_left, to_right, words`: phrases of two words or more with their lowest-scoring
    cut. Products are taken as decimals, as they may pass 64 bits."""
    w = F.split("phrase", " ")
    cuts = found.filter("n_words > 1").select(
        "lang", "phrase", F.col("f").alias("a"), "to_left", "to_right", w.alias("words"),
        F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.lit(DEPTH)), " ").alias("rest"))
    part = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    both = cuts.join(part, ["lang", "head"]).join(
        part.select("lang", F.col("head").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(19, 0)) * {scale}) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "to_left", "to_right", "words")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score", "b.to_left", "b.to_right", "b.words")


def not_within(candidates: DataFrame, within: int = WITHIN) -> DataFrame:
    """Candidates that no longer one contains with `within` hundredths of their count."""
    spans = [F.struct(F.array_join(F.slice("words", i + 1, k), " ").alias("phrase"), F.lit(i + k).alias("end"))
             for k in range(2, DEPTH) for i in range(DEPTH - k + 1)]
    inner = (candidates.select("lang", F.size("words").alias("n"), F.col("a").alias("longer"), F.explode(F.array(*spans)).alias("s"),
                               F.col("phrase").alias("whole"))
             .filter("s.end <= n AND s.phrase != whole")
             .groupBy("lang", F.col("s.phrase").alias("phrase")).agg(F.max("longer").alias("longer")))
    return (candidates.join(inner, ["lang", "phrase"], "left")
            .filter(f"longer IS NULL OR CAST(longer AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * {within}")
            .drop("longer"))


def first_of_each(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language with their rank. A language is first ranked in parts, so that only `top` rows
    of each part meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = parts.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(
        F.col("_at") <= top)
    return few.drop("_at", "_salt").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, top: int = TOP,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score, to_left, to_right`: each language's best phrases; their count, those of
    the two parts of the lowest-scoring cut, the words of the language, and the occurrences that have a word
    before and after them in their piece."""
    scratch = Scratch(docs.sparkSession, "phrases")
    found, n = count_phrases(docs, scratch, text, lang, least, DEPTH, shard_words)
    candidates = scratch.keep(scored(found))
    best = first_of_each(not_within(candidates), top)
    out = scratch.keep(best.join(n, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
        F.col("score").cast("bigint").alias("score"), "to_left", "to_right"))
    scratch.drop(out)
    return out


SQL = rf"""
WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f, count(*) FILTER (i > 1) AS to_left,
             count(*) FILTER (i + k <= len(w)) AS to_right
      FROM w, unnest(range(1, {DEPTH + 1})) AS b(k), unnest(range(1, len(w) + 2 - k)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {MIN_COUNT}),
e AS (SELECT *, unnest(range(1, k)) AS j FROM c),
h AS (SELECT lang, phrase, f AS a, j, to_left, to_right, array_to_string(w[1:j], ' ') AS head,
             array_to_string(w[j + 1:], ' ') AS rest FROM e),
x AS (SELECT h.*, l.f AS l, r.f AS r, {SCALE}::HUGEINT * h.a // (l.f + r.f) AS score FROM h
      JOIN g l ON l.lang = h.lang AND l.phrase = h.head JOIN g r ON r.lang = h.lang AND r.phrase = h.rest),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(f) AS longer
      FROM c, unnest(range(2, {DEPTH})) AS v(m), unnest(range(1, {DEPTH})) AS u(b) WHERE m < k AND b + m - 1 <= k GROUP BY ALL),
d AS (SELECT s.* FROM s LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {WITHIN}::HUGEINT * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score, to_left, to_right FROM t JOIN n USING (lang) WHERE rank <= {TOP}"""
