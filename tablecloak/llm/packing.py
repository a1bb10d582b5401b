"""Hierarchical packing of documents into training sequences of several context sizes.

A document's remainder below the longest context goes to the shortest tier that holds it. Each tier
is packed into windows of its own size: a window starts with the longest piece that waits in its tier, and its
gap is filled with the longest waiting piece that fits, from its own and ever shorter tiers. A part of the shorter
pieces is left for the gaps of the longer windows. Pieces wait by length, so whatever fits is found; only
where no waiting piece fits is one cut. When a task ends, the tokens left fill windows of
ever shorter context sizes (powers of two), so no window needs padding. Sequences are dealt to
step groups in order of their attention cost, back and forth, which evens out the groups.

Documents are packed within the task that encodes them: ids are never shuffled, a task holds a
bounded number of waiting tokens, and a lost task is simply run again on the same split of the
input. Sequence ids hold the task's number in the upper bits.

Edge cases: a null or empty text is a document of the closing id alone; a text of any length is cut
into whole windows; repeated rows are packed each on their own; other columns are ignored; an
empty table gives no sequences. Pieces of one document may lie in several sequences; each id lies in
exactly one piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablecloak.llm.common import ship

CONTEXT = 2048
TIERS = (128, 256, 512, 1024, 2048)
CLOSING_ID = 1
#: Tokens that may wait in a task before windows are packed.
WAITING = 64 * CONTEXT
#: Windows of its own that a shorter tier gets at most: one in so many of those that its tokens would fill.
SHARE = 2
STEP_SEQUENCES = 8
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, sequence_length int, tier int, step_group bigint")


@dataclass
class Piece:
    doc: int
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc, self.start, self.ids[:n], self.doc_tokens),
                Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens))


@dataclass
class TierPacker:
    """Packs a stream of documents; `ready` holds closed sequences as (size, pieces)."""

    context: int = CONTEXT
    tiers: tuple[int, ...] = TIERS
    ready: list[tuple[int, list[Piece]]] = field(default_factory=list)

    def __post_init__(self):
        self.tiers = tuple(sorted(self.tiers))
        self.pieces: dict[int, deque[Piece]] = {}
        self.lengths: list[int] = []  # of waiting pieces, rising
        self.waiting = 0

    def _wait(self, piece: Piece) -> None:
        n = len(piece.ids)
        if n not in self.pieces:
            self.pieces[n] = deque()
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.waiting += n

    def _take(self, place: int) -> Piece:
        """The piece that waits longest of those of one length."""
        n = self.lengths[place]
        piece = self.pieces[n].popleft()
        if not self.pieces[n]:
            del self.pieces[n], self.lengths[place]
        self.waiting -= n
        return piece

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.context * self.context
        for k in range(0, whole, self.context):
            self.ready.append((self.context, [Piece(doc, k, ids[k:k + self.context], len(ids))]))
        if whole < len(ids):
            self._wait(Piece(doc, whole, ids[whole:], len(ids)))
        if self.waiting > WAITING:
            self._pack_tiers()

    def _pack_tiers(self) -> None:
        """Windows of each tier from its own pieces, the longest tier first, until half of the tokens wait."""
        while self.waiting > WAITING // 2:
            for size, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0)):
                own = self.lengths[bisect_right(self.lengths, below):bisect_right(self.lengths, size)]
                tokens = sum(n * len(self.pieces[n]) for n in own)
                for _ in range(-(-tokens // size) if size == self.context else tokens // size // SHARE):
                    if self.waiting >= size and self.waiting > WAITING // 2:
                        self._window(size)
            if self.waiting > WAITING // 2:
                self._window(self.context)

    def _fitting(self, gap: int) -> Piece:
        """The longest waiting piece that fits the gap, else the head of the shortest one."""
        place = bisect_right(self.lengths, gap) - 1
        if place >= 0:
            return self._take(place)
        head, tail = self._take(0).cut(gap)
        self._wait(tail)
        return head

    def _window(self, size: int) -> None:
        pieces, gap = [], size
        while gap:
            pieces.append(self._fitting(gap))
            gap -= len(pieces[-1].ids)
        self.ready.append((size, pieces))

    def close(self) -> None:
        size = self.context
        while self.waiting:
            while self.waiting >= size:
                self._window(size)
            size //= 2


def balanced_groups(costs: list[int], per_group: int) -> list[int]:
    """The group of each sequence: in falling order of cost, dealt back and forth."""
    groups = -(-len(costs) // per_group)
    out = [0] * len(costs)
    for place, k in enumerate(sorted(range(len(costs)), key=lambda k: -costs[k])):
        turn, at = divmod(place, groups)
        out[k] = at if turn % 2 == 0 else groups - 1 - at
    return out


def sequence_rows(ready, first: int, task: int, group: int, per_group: int) -> list[tuple]:
    """Rows of closed sequences; equal sizes share step groups."""
    rows, by_size = [], {}
    for k, (size, _) in enumerate(ready):
        by_size.setdefault(size, []).append(k)
    dealt = {}
    for size, members in by_size.items():
        cost = [sum(len(p.ids) ** 2 for p in ready[k][1]) for k in members]
        places = balanced_groups(cost, per_group)
        dealt.update(zip(members, (group + g for g in places)))
        group += max(places) + 1
    for k, (size, pieces) in enumerate(ready):
        offset = 0
        for p in pieces:
            rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens,
                         (task << 33) + first + k, offset, size, size, (task << 33) + dealt[k]))
            offset += len(p.ids)
    return rows, group


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", context: int = CONTEXT,
         tiers: tuple[int, ...] = TIERS, closing_id: int = CLOSING_ID,
         step_sequences: int = STEP_SEQUENCES) -> DataFrame:
    """One row per piece: its document, place and checksum, its sequence and the offset there, the
    sequence's length, and the step group. `context` is a power of two and the largest tier."""
    if context & (context - 1) or max(tiers) != context:
        raise ValueError("the context is a power of two and the largest tier")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tablecloak.llm import packing as p
        from tablecloak.llm.byte_bpe import file_encoder

        encoder = file_encoder(path)
        packer = p.TierPacker(context, tiers)
        task, first, group = TaskContext.get().partitionId(), 0, 0
        names = [key, *(x.split()[0] for x in p.SCHEMA.split(", ")[1:])]
        types = pa.schema(list(zip(names, [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()])))
        closing = np.array([closing_id], "<u4")

        def flush():
            nonlocal first, group
            rows, group = p.sequence_rows(packer.ready, first, task, group, step_sequences)
            first += len(packer.ready)
            packer.ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], names)

        for batch in batches:
            for at, found, ends in encoder.batches(batch.column(1)):
                for k, ids in enumerate(np.split(found, ends[1:-1])):
                    packer.add(batch.column(0)[at + k].as_py(), np.concatenate((ids, closing)))
                if len(packer.ready) >= 64 * step_sequences:
                    yield flush()
        packer.close()
        if packer.ready:
            yield flush()

    return docs.select(key, text).mapInArrow(run, SCHEMA.replace("doc_id", f"`{key}`", 1))
