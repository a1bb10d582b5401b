"""Near duplicates: fast similarity sketches, banding, exact verification, components.

A document is its set of distinct word shingles. Equal sets form a class and only its smallest id
goes on. The sketch places all members of a set into `t` bins per round, each round under a new
hash function, and a bin keeps the smallest hash of the first round that reached it. Rounds stop
when every bin is filled; from round t on a round sends all members to one bin of its own, so 2t
rounds always do. Equal coordinates estimate the Jaccard similarity with concentration like that of
t independent hash functions, in time near the size of the set instead of t times it.

Bands of `rows` coordinates make buckets. Links are confirmed on the full sets (54-bit hashes of
the shingles), and no bucket is expanded into all its pairs:
1. each member is compared with its bucket's smallest id, and confirmed links are joined up;
2. buckets that still hold several components compare members with another representative;
3. what is left is compared across components only: members outside a bucket's largest component
   against the others, where their rarest shingles meet (exact, see `_pairs_across`).
A pair within one component needs no comparison, so no component is lost. With 42 bands of six a
pair at similarity 0.8 shares no bucket with probability 3e-6, which falls steeply above 0.8.

Edge cases: null, empty and blank texts have empty sets, link with nothing and are kept; a text of
fewer words than a shingle is one shingle; rows of one id and one text are one node, and rows of one id
with different texts are judged each by its text; long texts are hashed in parts; other columns are ignored, so their names may clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecloak.llm.common import Scratch, ship

BANDS, ROWS = 42, 6
#: Bytes of text hashed at once; a longer text is taken alone and its words are hashed in parts.
CHUNK = 512 << 10
#: Bits that number the documents hashed at once; a shingle's hash has the others.
DOC_BITS = 10
#: Ids that are broadcast to pick documents; beyond it the two sides are shuffled.
BROADCAST_IDS = 2_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    out = []
    for base in (_BASE, _U(pow(int(_BASE), -1, 1 << 64))):
        p = np.full(n + 1, base)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; `first` marks where documents begin. A word's
    hash is a difference of one running polynomial sum, brought back to the word's start."""
    data = _LOWER[data]
    blank = _BLANK[data]
    before = np.concatenate(([True], blank[:-1])) | first[:-1]
    after = np.concatenate((blank[1:], [True])) | first[1:]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    up, down = _powers(max(CHUNK, len(data)))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)])))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about CHUNK bytes before white space."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            gap = np.flatnonzero(_BLANK[data[end:end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(end + 4096, len(data))
        yield at, end
        at = end


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of documents that lie one after another in `data`, the document of each word, and the
    number of words per document."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    found = [(h, s + a) for a, b in _parts(data) for h, s in [_words(data[a:b], first[a:b + 1])]]
    word, starts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    doc = np.searchsorted(offsets, starts, "right") - 1
    return word, doc, np.bincount(doc, minlength=len(offsets) - 1)


def shingles(word: np.ndarray, doc: np.ndarray, per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words by document, as hashes of 64 - DOC_BITS bits, and the document of each;
    a document with fewer words has them all as one."""
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(per_doc), per_doc) - np.arange(len(word))  # words from here to the end
    opens = np.concatenate(([True], doc[1:] != doc[:-1]))
    heads = np.flatnonzero((left >= k) | opens)
    size = np.minimum(left[heads], k)
    value = size.astype(np.uint64)
    for j in range(k):
        value = np.where(size > j, mix(value * _BASE + word[np.minimum(heads + j, len(word) - 1)]), value)
    both = (value >> _U(DOC_BITS)) | (doc[heads].astype(np.uint64) << _U(64 - DOC_BITS))
    both.sort()
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return both & _U((1 << (64 - DOC_BITS)) - 1), (both >> _U(64 - DOC_BITS)).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_table(data, offsets), k)


def sketches(value: np.ndarray, doc: np.ndarray, docs: int, t: int) -> np.ndarray:
    """`docs` x `t` coordinates; a row without members stays at the largest number."""
    out = np.full(docs * t, ~_U(0))
    filled = np.zeros(docs * t, bool)
    for r in range(2 * t):
        if not len(value):
            break
        x = mix(value ^ mix(np.array([r + 1], np.uint64) * _BASE))
        place = ((x >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if r < t else r - t
        slot = doc * t + place
        free = ~filled[slot]
        slot = slot[free]
        np.minimum.at(out, slot, mix(x[free] + _BASE))
        filled[slot] = True
        open_docs = ~filled.reshape(docs, t).all(1)
        rest = open_docs[doc]
        value, doc = value[rest], doc[rest]
    return out.reshape(docs, t)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK bytes: first row, their bytes, and offsets."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        end = min(end, at + (1 << DOC_BITS))
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end
    pa.default_memory_pool().release_unused()  # workers live on and share an executor's memory


def _lists(rows: np.ndarray, empty: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width),
        pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)), mask=pa.array(empty))


def _sums(x: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Sums by document, modulo 2^64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    at = np.searchsorted(doc, np.arange(docs + 1))
    return total[at[1:]] - total[at[:-1]]


def sketch_table(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """`id, n, key1, key2, bands`: the size and a 128-bit digest of the set, and the bucket of each band.
    Without words n is 0 and there are no bands."""
    ship(docs.sparkSession)
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import near_dup as m

        for batch in batches:
            for at, data, offsets in m.text_chunks(batch.column(1)):
                n = len(offsets) - 1
                value, doc = m.shingle_sets(data, offsets, k)
                size = np.bincount(doc, minlength=n)
                sketch = m.sketches(value, doc, n, t)
                banded = sketch.reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
                for r in range(rows):
                    key = m.mix(key * m._BASE + banded[:, :, r])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(size.astype(np.int64)),
                     pa.array(m._sums(m.mix(value), doc, n).view(np.int64)),
                     pa.array(m._sums(m.mix(value ^ m._BASE), doc, n).view(np.int64)),
                     m._lists(key, size == 0)], ["id", "n", "key1", "key2", "bands"])

    return docs.mapInArrow(run, "id bigint, n bigint, key1 bigint, key2 bigint, bands array<bigint>")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """`id, shingles`: the full sets, as sorted hashes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import near_dup as m

        for batch in batches:
            for at, data, offsets in m.text_chunks(batch.column(1)):
                n = len(offsets) - 1
                value, doc = m.shingle_sets(data, offsets, k)
                ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64)))],
                    ["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles array<bigint>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`node, label`: the smallest node reachable, for the nodes of `edges(a, b)`. Labels pass along
    edges and then jump to their label's label, until nothing changes."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")))
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                          .select("node", F.least("node", "m").alias("label")))
    while True:
        seen = (both.join(labels, both.b == labels.node).select(both.a.alias("node"), "label")
                .union(labels.select("node", "label")))
        passed = scratch.keep(seen.groupBy("node").agg(F.min("label").alias("label")))
        target = passed.select(F.col("node").alias("via"), F.col("label").alias("far"))
        old = labels.select(F.col("node").alias("was_node"), F.col("label").alias("was"))
        jumped = scratch.keep(passed.join(target, F.col("label") == F.col("via"))
                              .join(old, F.col("node") == F.col("was_node"))
                              .select("node", F.least("label", "far").alias("label"), "was"))
        done = jumped.filter(F.col("label") != F.col("was")).isEmpty()
        labels = jumped.select("node", "label")
        if done:
            return labels


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a, b` whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    size_a, size_b = F.size("set_a"), F.size("set_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b")
            .filter(100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
            .withColumn("common", common)
            .filter(100 * F.col("common") >= percent * (size_a + size_b - F.col("common")))
            .select("a", "b"))


def _pairs_across(open_docs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components that may reach the similarity, of which one is `minor`.

    Shingles have one order, rare ones first. All that two sets have in common comes after the first
    common shingle in either, so for a link that shingle is followed by enough others in both; it
    lies among the first, rare ones, and only these are joined."""
    rows = scratch.keep(sets.join(open_docs.select("id"), "id", "left_semi")
                        .select("id", F.explode("shingles").alias("shingle")))
    times = scratch.keep(rows.groupBy("shingle").agg(F.count("*").alias("times")))
    ordered = rows.join(times, "shingle").groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct("times", "shingle"))).alias("s")).withColumn("n", F.size("s"))
    first = F.expr(f"slice(s, 1, n - CAST(ceil({percent} * n / 100) AS INT) + 1)")
    heads = scratch.keep(ordered.select("id", "n", F.posexplode(first).alias("at", "x")).filter("x.times > 1")
                         .select("id", F.col("x.shingle").alias("shingle"), "n", (F.col("n") - F.col("at")).alias("rest"))
                         .join(open_docs, "id"))
    a = heads.filter("minor").select(*[F.col(c).alias(f"{c}_a") for c in heads.columns])
    b = heads.select(*[F.col(c).alias(f"{c}_b") for c in heads.columns])
    near = ((F.col("comp_a") != F.col("comp_b")) & (~F.col("minor_b") | (F.col("id_a") < F.col("id_b")))
            & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & ((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))))
    return (a.join(b, (F.col("shingle_a") == F.col("shingle_b")) & near)
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())


def _pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`key, n_shingles, component_id, kept`: each row's set size, the smallest id reachable over links of
    at least `percent` Jaccard similarity, and whether it is the row's own. Ids are integers. A row
    whose id is null takes no part: it is its own component (null) and kept."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    table = scratch.keep(sketch_table(source, shingle_words, bands, rows))
    members = table.filter("n > 0 AND id IS NOT NULL")
    classes = scratch.keep(members.groupBy("key1", "key2", "n").agg(
        F.min("id").alias("id"), F.any_value("bands").alias("bands")))

    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = scratch.keep(buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size"))
                          .filter("size > 1").select("bucket", "hub"))
    placed = scratch.keep(buckets.join(shared, "bucket"))
    stars = scratch.keep(placed.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    ids = scratch.keep(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct())
    sets = scratch.keep(set_table(_pick(source, ids), shingle_words))
    edges = scratch.keep(_linked(stars, sets, percent))
    labels = components(edges, scratch)

    def settled() -> tuple[DataFrame, DataFrame]:
        """Members of shared buckets with their component, and buckets that hold several."""
        own = labels.select(F.col("node").alias("id"), "label")
        rows_ = scratch.keep(placed.join(own, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("comp")))
        several = (rows_.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                   .filter("x != y").select("bucket"))
        return rows_, several

    now, several = settled()
    second = now.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), "id", "comp")).alias("rep"),
        F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y")
    second = scratch.keep(second.select("bucket", F.col("rep.id").alias("rep"), F.col("rep.comp").alias("rep_comp")))
    tried = now.join(second, "bucket").filter("comp != rep_comp").select(
        F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
    more = scratch.keep(_linked(tried.join(stars, ["a", "b"], "left_anti"), sets, percent))
    if not more.isEmpty():
        edges = scratch.keep(edges.union(more))
        labels = components(edges, scratch)
        now, several = settled()

    several = scratch.keep(several)
    counted = now.join(several, "bucket").groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    main = scratch.keep(counted.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("most"))
                        .select("bucket", F.col("most.comp").alias("main")))
    open_docs = scratch.keep(now.join(main, "bucket").groupBy("id", "comp").agg(
        F.max(F.col("comp") != F.col("main")).alias("minor")))
    rest = scratch.keep(_pairs_across(open_docs, sets, percent, scratch))
    last = scratch.keep(_linked(rest, sets, percent))
    if not last.isEmpty():
        edges = scratch.keep(edges.union(last))
        labels = components(edges, scratch)

    own = labels.select(F.col("node").alias("id"), "label")
    resolved = scratch.keep(classes.select("key1", "key2", "n", "id").join(own, "id", "left")
                            .select("key1", "key2", "n", F.coalesce("label", "id").alias("component")))
    out = scratch.keep(table.select("id", "n", "key1", "key2").join(resolved, ["key1", "key2", "n"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))
    scratch.drop(out)
    return out
