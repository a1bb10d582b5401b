"""Quality classifier from weak labels.

Overlapping heuristics each vote junk, good or abstain. Expectation-maximisation over the counts of
vote patterns in the whole table (at most 3 to the number of labellers rows) estimates the share of good
rows and of each kind of junk, and how each labeller votes on them. The posteriors label a bounded sample
(SAMPLE documents, first by a hash of the id), on which a linear scorer over hashed features is fitted:
class trigrams of the characters and buckets of the measurements. The scorer then judges every row (of fewer
than WORDS words the posterior does). No measure depends on the length of a text or on its script: different
words are counted in blocks, and characters of scripts without spaces make no long words.

Edge cases: null, empty and blank texts have no words; all labellers but the one on length abstain,
and such rows are not kept; repeated rows are judged each on their own; a text of any length is
measured whole, in parts; other columns are ignored; an empty table gives an empty result; a table on
which all patterns are equal gives every row the same posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecloak.llm import near_dup
from tablecloak.llm.common import ship

SAMPLE = 4000
FEATURES = 1024
JUNK, GOOD, ABSTAIN = 1, 0, 2
#: Measurements per document.
MEASURES = ("words", "letters", "upper", "digits", "symbols", "bangs", "bars", "spaced", "block_words", "block_distinct",
            "block_pairs", "block_places")
#: Words of a block in which different words and pairs are counted (their share in a whole text falls with its
#: length), and the least words of a text's last block but for its only one.
BLOCK, LEAST_BLOCK = 200, 20
#: Words from which on a text is scored.
WORDS = 4
#: Rows that the prior of a kind of junk, and that of the good class, weigh as much as.
PRIOR, GOOD_PRIOR = 5, 100
#: First bytes (and ranges of second bytes) of characters of scripts without spaces in UTF-8.
WIDE_LEADS = range(0xE3, 0xEA)
WIDE_SECONDS = {0xE0: range(0xB8, 0xBC), 0xE1: (0x80, 0x81, 0x82, 0x9E, 0x9F)}
WIDE = 8
#: Labellers: name, numerator, denominator, least words; junk above or below, good below or above.
LABELLERS = (
    ("symbols", "symbols", "words", 1, (">", 0.3), ("<", 0.05)),
    ("capitals", "upper", "letters", 3, (">", 0.5), ("<", 0.2)),
    ("exclamations", "bangs", "words", 1, (">", 0.3), ("<", 0.05)),
    ("bars", "bars", "words", 1, (">", 0.3), ("<", 0.05)),
    ("distinct_words", "block_distinct", "block_words", 20, ("<", 0.08), (">", 0.2)),
    ("distinct_pairs", "block_pairs", "block_places", 20, ("<", 0.35), (">", 0.6)),
    ("word_length", "spaced", "words", 3, (">", 20.0), ("<", 14.0)),
    ("length", "words", "one", 0, ("<", 1.0), (">", 8.0)),
)


def _class_table() -> np.ndarray:
    """Ten classes of bytes; a character beyond ASCII counts as a small letter."""
    out = np.full(256, 1, np.int64)
    out[:128] = 8
    for k, characters in enumerate(("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
                                    " \t\r\x0b\x0c", ".,;:?'\"-()", "#*$%&<>", "!", "", "|")):
        out[[ord(c) for c in characters]] = k
    out[10] = 0
    return out


CLASS = _class_table()


def character_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that begins at each byte, -1 within a character; WIDE for scripts without spaces."""
    kind = CLASS[data]
    kind[(data & 0xC0) == 0x80] = -1
    wide = (data >= WIDE_LEADS[0]) & (data <= WIDE_LEADS[-1])
    for first, seconds in WIDE_SECONDS.items():
        at = np.flatnonzero(data[:-1] == first)
        wide[at[np.isin(data[at + 1], list(seconds))]] = True
    kind[wide] = WIDE
    return kind


def in_blocks(word: np.ndarray, doc: np.ndarray, per_doc: np.ndarray) -> dict[str, np.ndarray]:
    """By document: words in blocks and pairs that begin with them, and how many of each block differ."""
    n = len(per_doc)
    blocks = -(-per_doc // BLOCK)
    place = np.arange(len(word)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    block = np.repeat(np.cumsum(blocks) - blocks, per_doc) + place // BLOCK
    size = np.bincount(block, minlength=int(blocks.sum()))
    counted = (size[block] >= LEAST_BLOCK) | (place < BLOCK)
    of = np.repeat(np.arange(n), blocks)  # the document of each block
    follows = counted.copy()
    follows[:-1] &= doc[1:] == doc[:-1]
    follows[-1:] = False
    pair = near_dup.mix(word * near_dup._BASE + np.roll(word, -1))
    out = {"block_words": np.bincount(doc[counted], minlength=n),
           "block_places": np.maximum(np.bincount(doc[follows], minlength=n), 1)}
    for name, value, there in (("block_distinct", word, counted), ("block_pairs", pair, follows)):
        both = np.sort(block[there].astype(np.uint64) << np.uint64(40) | value[there] >> np.uint64(24))
        new = both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]
        out[name] = np.bincount(of[(new >> np.uint64(40)).astype(np.int64)], minlength=n)
    return out


def measure_chunk(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of documents that lie one after another, in characters and words."""
    n = len(offsets) - 1
    kind = character_kinds(data)
    begins = kind >= 0
    doc = np.repeat(np.arange(n) * 10, np.diff(offsets))
    count = np.bincount(doc[begins] + kind[begins], minlength=n * 10).reshape(n, 10).T
    word, in_doc, words = near_dup.word_table(data, offsets)
    spaced = count[1] + count[2]
    return {"words": words, "letters": spaced + count[WIDE], "upper": count[2], "digits": count[3],
            "symbols": count[6], "bangs": count[7], "bars": count[9], "spaced": spaced,
            "one": np.ones(n, np.int64), **in_blocks(word, in_doc, words)}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Documents by labellers: junk, good or abstain."""
    out = np.full((len(m["words"]), len(LABELLERS)), ABSTAIN)
    for k, (_, top, base, least, junk, good) in enumerate(LABELLERS):
        ratio = m[top] / np.maximum(m[base], 1)
        for vote, (side, bound) in ((JUNK, junk), (GOOD, good)):
            out[(m["words"] >= least) & ((ratio > bound) if side == ">" else (ratio < bound)), k] = vote
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def features(data: np.ndarray, offsets: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed features: shares of class trigrams, and a bucket of each ratio."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if len(data) >= 3:
        kinds = character_kinds(data)
        kinds[kinds == WIDE] = 1  # letters like any others
        doc = np.repeat(np.arange(n), np.diff(offsets))[kinds >= 0]
        kinds = kinds[kinds >= 0]
        code = kinds[:-2] * 100 + kinds[1:-1] * 10 + kinds[2:]
        place = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
        same = doc[:-2] == doc[2:]
        out += np.bincount(doc[:-2][same] * FEATURES + place[same], minlength=n * FEATURES).reshape(n, FEATURES)
        out /= np.maximum(out.sum(1, keepdims=True), 1)
        np.sqrt(out, out)
    row = np.arange(n)
    for k, (_, top, base, *_) in enumerate(LABELLERS):
        bucket = np.minimum(10 * m[top] / np.maximum(m[base], 1), 20).astype(np.uint64)
        place = near_dup.mix(bucket + np.uint64(100 * (k + 1))) % np.uint64(FEATURES)
        out[row, place.astype(np.int64)] += 0.3
    return out


@dataclass
class LabelModel:
    """A good class and one kind of junk per labeller: their shares, and how likely each labeller's votes
    are in each (labellers x classes x votes)."""

    share: np.ndarray
    likely: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.share)[None, :].repeat(len(v), 0)
        for k in range(v.shape[1]):
            log += np.log(self.likely[k][:, v[:, k]]).T
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def junk(self) -> np.ndarray:
        """The classes that are a kind of junk: their own labeller blames most of their rows."""
        own = np.array([self.likely[k][k + 1, JUNK] for k in range(len(self.likely))])
        return np.concatenate(([False], own > 0.5))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of junk of any kind."""
        return self.classes(v)[:, self.junk()].sum(1)

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per labeller how often a vote on good, and on junk, is right."""
        kinds = self.junk()
        good, bad = (self.share * x / max((self.share * x).sum(), 1e-12) for x in (~kinds, kinds))
        return {name: (float(good @ self.likely[k][:, GOOD]), float(bad @ self.likely[k][:, JUNK]))
                for k, (name, *_) in enumerate(LABELLERS)}


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over vote patterns. Labellers look for different faults, so one class of
    junk could not explain that most of them find a document good; each kind starts from the rows
    whose first junk vote is its labeller's. Abstaining tells nothing, but that a row is hardly the kind of junk
    that the labeller looks for. Votes alone cannot tell a
    fault that one labeller sees from false alarms that meet no other vote; the start reads both as junk."""
    v = votes_of(patterns)
    junk = v == JUNK
    p = np.full((len(v), 1 + len(LABELLERS)), 0.02 / len(LABELLERS))
    p[np.arange(len(v)), np.where(junk.any(1), 1 + junk.argmax(1), 0)] = 0.98
    k_all = v.shape[1]
    said = np.stack([(v == x).astype(float) for x in (GOOD, JUNK)])  # votes x patterns x labellers
    # the prior: a labeller seldom blames a row but for its own kind of junk
    lean = np.full((k_all, 1 + k_all, 2), (0.99, 0.01))
    lean[np.arange(k_all), 1 + np.arange(k_all)] = (0.01, 0.99)
    lean[:, 0] = (0.999, 0.001)
    rows = np.full((1, 1 + k_all, 1), float(PRIOR))
    rows[0, 0] = GOOD_PRIOR
    for _ in range(rounds):
        weight = counts[:, None] * p
        share = weight.sum(0) + PRIOR / 10
        seen = np.stack([x.T @ weight for x in said], 2)
        likely = np.ones((k_all, 1 + k_all, 3))
        likely[:, :, :2] = (seen + rows * lean) / (seen.sum(2, keepdims=True) + rows)
        likely[np.arange(k_all), 1 + np.arange(k_all), ABSTAIN] = 0.01  # a kind of junk is what its labeller sees
        model = LabelModel(share / share.sum(), likely)
        new = model.classes(v)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighing the same; the last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight = (weight / weight.sum()).astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * (x.T @ (weight * (p - y)) + decay * w)
        w = w + speed
    return w


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(key), F.col(text))


def vote_patterns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`pattern` of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import near_dup as n
        from tablecloak.llm import weak_quality as w

        for batch in batches:
            for _, data, offsets in n.text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.pattern_of(w.votes(w.measure_chunk(data, offsets))))], ["pattern"])

    return _texts(docs, key, text).mapInArrow(run, "pattern bigint")


def _sample_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`id, pattern, x`, one row per id: of repeated rows the first by pattern and features."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import near_dup as n
        from tablecloak.llm import weak_quality as w

        for batch in batches:
            for at, data, offsets in n.text_chunks(batch.column(1)):
                m = w.measure_chunk(data, offsets)
                x = w.features(data, offsets, m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)), pa.array(w.pattern_of(w.votes(m))),
                     pa.array([r.tobytes() for r in x], pa.binary())], ["id", "pattern", "x"])

    found = _texts(docs, key, text).mapInArrow(run, f"id {kind}, pattern bigint, x binary")
    return found.groupBy("id").agg(F.min(F.struct("pattern", "x")).alias("_f")).select("id", "_f.*").orderBy("id")


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model | None:
    """The label model over all rows, and the scorer over at most `sample` rows. None without rows."""
    counts = vote_patterns(docs, key, text).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not counts:
        return None
    patterns, n = np.array([r.pattern for r in counts]), np.array([r.n for r in counts], float)
    labels = fit_labels(patterns, n)
    chosen = docs.select(key).orderBy(F.xxhash64(key), F.col(key)).limit(sample).distinct()
    rows = _sample_features(docs.join(F.broadcast(chosen), key, "left_semi"), key, text).collect()
    if not rows:
        return Model(labels, np.zeros(FEATURES + 1, np.float32))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    y = labels.posterior(votes_of(np.array([r.pattern for r in rows]))).astype(np.float32)
    return Model(labels, fit_scorer(x, y))


def classify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, votes, posterior, score, kept`: votes by labeller as letters (j, g, -), the label model's and
    the scorer's probability of junk, and whether the scorer's is below a half."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import near_dup as n
        from tablecloak.llm import weak_quality as w

        for batch in batches:
            for at, data, offsets in n.text_chunks(batch.column(1)):
                m = w.measure_chunk(data, offsets)
                v = w.votes(m)
                score = w.judged(model, data, offsets, m, v)
                letters = ["".join("gj-"[i] for i in r) for r in v]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(v)), pa.array(letters), pa.array(model.labels.posterior(v)),
                     pa.array(score), pa.array((score < 0.5) & (m["words"] > 0))],
                    [key, "votes", "posterior", "score", "kept"])

    schema = f"`{key}` {kind}, votes string, posterior double, score double, kept boolean"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return _texts(docs, key, text).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows that the scorer keeps, with their own columns."""
    if model is None:
        return docs
    ship(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import near_dup as n
        from tablecloak.llm import weak_quality as w

        for batch in batches:
            for at, data, offsets in n.text_chunks(batch.column(place)):
                m = w.measure_chunk(data, offsets)
                kept = (w.judged(model, data, offsets, m, w.votes(m)) < 0.5) & (m["words"] > 0)
                yield batch.slice(at, len(kept)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def scores(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((x @ weights[:-1] + weights[-1]).astype(float), -30, 30)))


def judged(model: Model, data: np.ndarray, offsets: np.ndarray, m: dict[str, np.ndarray], v: np.ndarray) -> np.ndarray:
    """The scorer's probability of junk. A text of fewer words than WORDS has too few trigrams to score, so there it
    is the label model's."""
    score = scores(model.weights, features(data, offsets, m))
    return np.where(m["words"] < WORDS, model.labels.posterior(v), score)


def label_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Fit on the rows and judge all of them."""
    return classify(docs, fit(docs, key, text, sample), key, text)
