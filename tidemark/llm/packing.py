"""Packing token ids into sequences: vector bin packing by the dot-product heuristic.

A sequence has room in three dimensions: tokens, segments (pieces) and
loss-bearing tokens.  Of the pieces waiting, the one whose needs have the
largest dot product with the room left, each dimension as a share of its limit,
goes in; when none fits, the best is cut to fill what is left.  Each input
partition is packed where it lies: no shuffle, and a lost task that is run
again over the same split makes the same sequences.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import in_slices, word_tokenizer

CAPACITY = 4096
#: Pieces in a sequence at most.
MAX_SEGMENTS = 64
#: Pieces that wait to be chosen from; further ones come as these are placed.
WAITING = 256
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


class Packer:
    """Packs items given by :meth:`add`; :meth:`take` gives the pieces placed since.

    An item is (key, ids, loss): any key, an int array, and whether its ids
    bear loss.  A piece is (key, start, ids, sequence, offset).
    """

    def __init__(self, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, waiting: int = WAITING):
        self.limits = np.array([capacity, max_segments, capacity if max_loss is None else max_loss], np.int64)
        if self.limits.min() < 1:
            raise ValueError("every limit must be at least 1")
        self.waiting, self.items, self.needs = waiting, [], np.zeros((0, 3), np.int64)
        self.sequence, self.placed = 0, []
        self._open()

    def _open(self) -> None:
        self.room = self.limits.copy()
        self.offset = 0

    def _close(self) -> None:
        self.sequence += 1
        self._open()

    def _put(self, item: tuple, n: int) -> tuple | None:
        """The first n ids of the item go into the open sequence; gives what is left of it."""
        key, start, ids, loss = item
        self.placed.append((key, start, ids[:n], self.sequence, self.offset))
        self.offset += n
        self.room -= (n, 1, n * loss)
        return (key, start + n, ids[n:], loss) if n < len(ids) else None

    def add(self, key, ids: np.ndarray, loss: bool = True) -> None:
        item = (key, 0, ids, bool(loss))
        full = min(int(self.limits[0]), int(self.limits[2]) if loss else int(self.limits[0]))
        while item and full == self.limits[0] and len(item[2]) >= full and not self.offset:
            item = self._put(item, full)  # whole sequences of one text need no search
            self._close()
        if item and len(item[2]):
            self.items.append(item)
        if len(self.items) >= 2 * self.waiting:
            self._pack(self.waiting)

    def _pack(self, down_to: int) -> None:
        items = self.items
        needs = np.array([(len(i[2]), 1, len(i[2]) * i[3]) for i in items], np.int64)
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > down_to:
            fits = alive & (needs <= self.room).all(1)
            if self.room[1] == 1 or not fits.any():  # the last segment, or nothing fits: one that fills the room, cut to it
                can = alive & (self.room[2] > 0) if self.room[2] < self.room[0] else alive
                loss_free = alive & (needs[:, 2] == 0)
                pool = can if can.any() else loss_free
                if self.room[1] < 1 or self.room[0] < 1 or not pool.any():
                    self._close()
                    continue
                k = int(np.argmax(np.where(pool, needs[:, 0], -1)))
                n = min(len(items[k][2]), int(self.room[0]), int(self.room[2]) if items[k][3] else int(self.room[0]))
            else:
                score = (needs / self.limits) @ (self.room / self.limits)
                k = int(np.argmax(np.where(fits, score, -1)))
                n = len(items[k][2])
            rest = self._put(items[k], n)
            if rest:
                items[k] = rest
                needs[k] = (len(rest[2]), 1, len(rest[2]) * rest[3])
            else:
                alive[k] = False
                left -= 1
            if self.room[0] == 0 or self.room[1] == 0:
                self._close()
        self.items = [i for i, a in zip(items, alive, strict=True) if a]

    def finish(self) -> None:
        """Place all that waits; the last sequence is divided at powers of two, so that it needs no padding."""
        while self.items:
            self._pack(0)
        if not self.offset:
            return
        last = [p for p in self.placed if p[3] == self.sequence]
        self.placed = [p for p in self.placed if p[3] != self.sequence]
        total, room = self.offset, 0
        for key, start, ids, _, _ in last:
            while len(ids):
                if not room:
                    room = size = 1 << (total.bit_length() - 1)
                    self.sequence += 1
                n = min(room, len(ids))
                self.placed.append((key, start, ids[:n], self.sequence - 1, size - room))
                ids, start, room, total = ids[n:], start + n, room - n, total - n
        self._open()

    def take(self, open_too: bool = False) -> list[tuple]:
        """Pieces of closed sequences (all pieces at the end)."""
        out = self.placed if open_too else [p for p in self.placed if p[3] != self.sequence]
        self.placed = [] if open_too else [p for p in self.placed if p[3] == self.sequence]
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = (pa.int64(),) * 7


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, loss: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all texts of ``docs`` (doc_id, text) and where each lies.

    A text's ids are the tokenizer's, then ``END_ID``; null text is empty and
    has the end alone.  Each id lies in exactly one piece; a text may be cut
    anywhere.  A sequence holds at most ``capacity`` ids, ``max_segments``
    pieces and ``max_loss`` ids of rows whose boolean column ``loss`` is not
    false (without such a column, all rows bear loss).  sequence_id is unique
    over the table: the partition, then a count.  Equal rows are packed each
    on its own.  A very long text is whole, in as many sequences as it fills.
    An empty table gives no pieces.  with_ids adds the ids themselves.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        packer = Packer(capacity, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 32
        sizes: dict[int, list] = {}  # of texts not wholly placed: doc_id, ids, ids still to come
        count = 0

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            rows = []
            for key, start, ids, sequence, offset in pieces:
                doc = sizes[key]
                rows.append((doc[0], start, len(ids), binascii.crc32(ids.astype("<u4").tobytes()), doc[1], base + sequence, offset))
                doc[2] -= len(ids)
                if not doc[2]:
                    del sizes[key]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)]
            if with_ids:
                columns.append(pa.array([p[2].tolist() for p in pieces], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            docs_, texts, bear = (batch.column(k).to_pylist() for k in range(3))
            for a, b in in_slices(texts):
                for doc, ids, l in zip(docs_[a:b], words.encode(texts[a:b]), bear[a:b], strict=True):
                    ids = np.append(ids, np.int32(END_ID))
                    sizes[count] = [doc, len(ids), len(ids)]
                    packer.add(count, ids, l is not False)
                    count += 1
                if done := packer.take():
                    yield out(done)
        packer.finish()
        if done := packer.take(open_too=True):
            yield out(done)

    bears = F.col(loss).cast("boolean") if loss else F.lit(None).cast("boolean")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bears.alias("loss")).mapInArrow(lean(run), schema)
