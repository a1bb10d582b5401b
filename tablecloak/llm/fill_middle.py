"""Fill-in-middle transformation by displacement scatter.

A text is cut twice at token ends and its three parts change places behind marks: `<P>` prefix `<S>`
suffix `<M>` middle (psm), or `<S>` suffix `<P>` prefix `<M>` middle (spm). All texts of a batch lie in
one byte array. Cuts are scanned from the ends of its tokens; a difference array holds at the first byte
of each part by how much its shift differs from that of the part before, so the running sum is the
output shift of every byte, and one scatter writes all outputs. Restoring looks for the marks in the
outputs, builds the differences of the inverse shifts, and gathers.

The cuts, whether a text is transformed and its form come from sha256 of seed and id, so a lost task
that runs again gives the same rows.

Edge cases: a null or empty text is plain and has no tokens; a text that holds a mark is plain, so that
every output can be restored; a null id counts as the empty string in the digest; repeated rows are
transformed alike; a very long text is moved in blocks; a text of white space alone is one token; other
columns are ignored, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecloak.llm.common import SPACE, ship
from tablecloak.llm.near_dup import text_chunks

SEED = 42
#: Texts in a hundred that are transformed, and of these the ones in a hundred that are spm.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes whose shifts are held at once.
BLOCK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def checked_marks(marks: tuple[str, str, str]) -> list[bytes]:
    """Marks as bytes. Each begins with a character that no mark has at another place, so a mark is never
    found half in a text and half in a mark; none begins another."""
    heads = {m[:1] for m in marks}
    if "" in heads or any(c in heads for m in marks for c in m[1:]):
        raise ValueError("a mark begins with a character that no mark has at another place")
    if any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError("no mark begins another")
    return [m.encode() for m in marks]


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of texts that lie one after another, and the number of tokens of each: a word
    with the white space before it, or white space at the end of a text."""
    blank = _BLANK[data]
    closes = np.ones(len(data), bool)  # a byte after which a word or a text ends
    closes[:-1] = blank[1:]
    closes &= ~blank
    filled = offsets[1:] > offsets[:-1]
    closes[offsets[1:][filled] - 1] = True
    ends = np.flatnonzero(closes) + 1
    return ends, np.diff(np.searchsorted(ends, offsets, "right"))


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits for each id."""
    digest = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digest, ">u4").reshape(-1, 4).astype(np.int64)


def _running(at: np.ndarray, change: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of the running sum of a difference array, given by its places (rising; of equal ones all
    count) and values: first byte, end, and each byte's place plus its sum."""
    carry = 0
    for a in range(0, size, BLOCK):
        b = min(a + BLOCK, size)
        lo, hi = np.searchsorted(at, (a, b))
        step = np.ones(b - a, np.int64)
        step[0] = a + carry
        np.add.at(step, at[lo:hi] - a, change[lo:hi])
        carry += int(change[lo:hi].sum())
        yield a, b, np.cumsum(step)


def _changes(starts: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The difference array of parts that begin at `starts` (rising) and move by `shifts`."""
    return starts, np.diff(shifts, prepend=0)


def scatter(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, order: np.ndarray,
            marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of texts and their offsets. `cuts` are the two cuts of each, in bytes of `data`; `order` is
    -1 for a plain text, else 0 for psm and 1 for spm."""
    n = len(offsets) - 1
    moved = order >= 0
    width = np.array([len(m) for m in marks], np.int64)
    sizes = np.diff(offsets)
    out_offsets = np.concatenate(([0], np.cumsum(sizes + moved * width.sum())))
    # input parts: prefix, middle, suffix
    bounds = np.stack((offsets[:-1], cuts[:, 0], cuts[:, 1], offsets[1:]), 1)
    p, m, s = (bounds[:, k + 1] - bounds[:, k] for k in range(3))
    base, psm = out_offsets[:-1], order == 0
    # places of the marks of prefix, suffix and middle
    mark_at = np.stack((np.where(psm, 0, width[1] + s), np.where(psm, width[0] + p, 0),
                        width[0] + p + width[1] + s), 1) + base[:, None]
    to = np.where(moved[:, None], np.stack((mark_at[:, 0] + width[0], mark_at[:, 2] + width[2],
                                            mark_at[:, 1] + width[1]), 1),
                  np.stack((base, base + p, base + p + m), 1))
    keep = bounds[:, :3].ravel() < bounds[:, 1:].ravel()  # an empty part moves nothing
    starts = bounds[:, :3].ravel()[keep]
    at, change = _changes(starts, to.ravel()[keep] - starts)
    out = np.empty(out_offsets[-1], np.uint8)
    for a, b, place in _running(at, change, len(data)):
        out[place] = data[a:b]
    for k, mark in enumerate(marks):
        place = mark_at[moved, k]
        for j, byte in enumerate(mark):
            out[place + j] = byte
    return out, out_offsets


def found_marks(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Places of a mark in bytes."""
    if len(data) < len(mark):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:len(data) - len(mark) + 1] == mark[0])
    for j, byte in enumerate(mark[1:], 1):
        at = at[data[at + j] == byte]
    return at


def gather(data: np.ndarray, offsets: np.ndarray, order: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs, from the outputs and their forms alone, and their offsets."""
    moved = order >= 0
    width = np.array([len(m) for m in marks], np.int64)
    firsts = []  # the first place of each mark in each output that has been moved
    for mark in marks:
        at = found_marks(data, mark)
        k = np.searchsorted(at, offsets[:-1])
        firsts.append(at[np.minimum(k, max(len(at) - 1, 0))] if len(at) else np.zeros(len(moved), np.int64))
        lost = moved & ((k == len(at)) | (firsts[-1] + len(mark) > offsets[1:]))
        if lost.any():
            raise ValueError("an output lacks a mark of its form")
    prefix, suffix, middle = firsts
    psm, end = order == 0, offsets[1:]
    # output parts in the order of the text: prefix, middle, suffix
    begin = np.where(moved[:, None], np.stack((prefix + width[0], middle + width[2], suffix + width[1]), 1),
                     np.stack((offsets[:-1], end, end), 1))
    stop = np.where(moved[:, None], np.stack((np.where(psm, suffix, middle), end, np.where(psm, middle, prefix)), 1),
                    np.stack((end, end, end), 1))
    text_offsets = np.concatenate(([0], np.cumsum((stop - begin).sum(1))))
    size = (stop - begin).ravel()
    starts = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    keep = size > 0
    at, change = _changes(starts[keep], begin.ravel()[keep] - starts[keep])
    out = np.empty(text_offsets[-1], np.uint8)
    for a, b, place in _running(at, change, len(out)):
        out[a:b] = data[place]
    return out, text_offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                            pa.py_buffer(data)).cast(pa.string())


def _order(forms: np.ndarray) -> np.ndarray:
    return np.select([forms == PSM, forms == SPM], [0, 1], -1)


def transform_chunk(ids: list, texts: pa.Array, data: np.ndarray, offsets: np.ndarray, seed: int, rate: int,
                    spm_rate: int, marks: list[bytes]) -> list[pa.Array]:
    """Number of tokens, form, characters of prefix and middle, and output of each text."""
    ends, n = token_ends(data, offsets)
    h = draws(ids, seed)
    first, second = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    own = np.cumsum(n) - n  # the first token of each text
    every = np.concatenate((ends, [0]))
    units = np.stack((np.minimum(first, second), np.maximum(first, second)), 1)
    cuts = np.where(units > 0, every[np.maximum(own[:, None] + units - 1, 0)], offsets[:-1, None])
    marked = np.zeros(len(ids), bool)
    for m in marks:
        marked |= pc.fill_null(pc.match_substring(texts, m.decode()), False).to_numpy(zero_copy_only=False)
    plain = marked | (offsets[1:] == offsets[:-1]) | (h[:, 2] % 100 >= rate)
    order = np.where(plain, -1, np.where(h[:, 3] % 100 < spm_rate, 1, 0))
    out, out_offsets = scatter(data, offsets, cuts, order, marks)
    opened = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before a byte
    chars = np.diff(opened[np.column_stack((offsets[:-1], cuts))], axis=1)
    return [pa.array(n.astype(np.int64)), pa.array(np.array([PSM, SPM, PLAIN])[order]),
            *(pa.array(chars[:, k].astype(np.int64), mask=plain) for k in (0, 1)), _strings(out, out_offsets)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """`key, n, form, prefix_chars, middle_chars, output`: the tokens of the text, plain, psm or spm, the
    code points of its parts (null if plain), and the text as it goes to training."""
    coded = checked_marks(marks)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import fill_middle as m

        for batch in batches:
            for at, data, offsets in m.text_chunks(batch.column(1)):
                part = batch.slice(at, len(offsets) - 1)
                columns = m.transform_chunk(part.column(0).to_pylist(), part.column(1), data, offsets, seed, rate,
                                            spm_rate, coded)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored",
            marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All columns and the text rebuilt from output and form. Null outputs are empty texts; a null form is
    plain; an output without the marks of its form stops the job."""
    coded = checked_marks(marks)
    ship(rows.sparkSession)
    places = rows.columns.index(output), rows.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import fill_middle as m

        for batch in batches:
            forms = np.array(batch.column(places[1]).to_pylist(), object)
            for at, data, offsets in m.text_chunks(batch.column(places[0])):
                part = batch.slice(at, len(offsets) - 1)
                found = m.gather(data, offsets, m._order(forms[at:at + len(offsets) - 1]), coded)
                yield pa.RecordBatch.from_arrays([*part.columns, m._strings(*found)], [*part.schema.names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`, by way of both directions."""
    def sha(name: str) -> Column:
        return F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")

    both = restore(transform(docs, key, text))
    return both.select(key, "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


def _hex(place: int) -> str:
    return f"CAST('0x' || substr(x, {8 * place + 1}, 8) AS BIGINT)"


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
                  regexp_extract_all(coalesce(text, ''), '[{SPACE}]*[^{SPACE}]+|[{SPACE}]+') AS w FROM documents),
h AS (SELECT *, len(w) AS n, {_hex(0)} % (len(w) + 1) AS a, {_hex(1)} % (len(w) + 1) AS b,
             CASE WHEN t = '' OR {' OR '.join(f"contains(t, '{m}')" for m in MARKS)} OR {_hex(2)} % 100 >= {RATE}
                  THEN '{PLAIN}' WHEN {_hex(3)} % 100 < {SPM_RATE} THEN '{SPM}' ELSE '{PSM}' END AS form FROM t),
p AS (SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(w[greatest(a, b) + 1:n], '') AS s FROM h)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> '{PLAIN}' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> '{PLAIN}' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN '{PLAIN}' THEN t WHEN '{PSM}' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                   ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""
