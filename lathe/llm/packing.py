"""Harmonic packing of token ids into sequences of a fixed capacity.

A document's ids fill as many whole sequences as they can.  What is left, the tail, has a length of at most
``capacity / k`` and more than ``capacity / (k + 1)`` for one k, its reciprocal-capacity class.  A class's bin takes exactly
k tails, so a worker fills bins of all classes one document at a time, holding at most one open bin for each class and
asking no other worker.  A bin that has its k tails is short of its capacity by a gap.  Without more, these gaps are the
padding (``HarmonicPacker.gaps``).  So a tail that fits into the gaps standing open goes there whole, cut from one bin to the
next, and into no class; the gaps that stand open are thus never more than the longest tail.  At a worker's end the tails of
bins still open fill the last gaps and are run together; the last sequence is cut into powers of two, which need no padding.

Each task's bins depend on its own rows alone: a lost task gives the same pieces when run again.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import id_and_text, read_table, rebatch
from lathe.llm.tokens import default_vocabulary, encode_texts

CAPACITY = 2048
CLASSES = 32
END_ID = 1
#: Sequence numbers of one task; the task's number stands above them.
TASK_BITS = 40

Piece = tuple  # (doc_id, start, ids, doc_tokens)


class HarmonicPacker:
    """One worker's open bins.  ``add`` and ``finish`` return rows (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.open: dict[int, list[Piece]] = {}
        #: Bins that have their count of tails, with their gaps.
        self.short: deque[tuple[list[Piece], int]] = deque()
        self.gap = 0
        #: Ids placed, and what the class bins alone would pad.
        self.placed = self.gaps = 0
        self.sequence = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, ids, doc_tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _fill(self, piece: Piece) -> Piece | None:
        """Put as much of a piece as fits into the bins that are short, in order; the rest of the piece."""
        doc_id, start, ids, doc_tokens = piece
        while self.short and len(ids):
            pieces, gap = self.short.popleft()
            taken = min(gap, len(ids))
            pieces.append((doc_id, start, ids[:taken], doc_tokens))
            start, ids, gap = start + taken, ids[taken:], gap - taken
            self.gap -= taken
            if gap:
                self.short.appendleft((pieces, gap))
            else:
                self._close(pieces)
        return (doc_id, start, ids, doc_tokens) if len(ids) else None

    def _short(self, pieces: list[Piece]) -> None:
        gap = self.capacity - sum(len(p[2]) for p in pieces)
        if gap:
            self.short.append((pieces, gap))
            self.gap += gap
        else:
            self._close(pieces)

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        self.placed += n
        while n - start >= self.capacity:
            self._close([(doc_id, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        if start == n:
            return
        tail = (doc_id, start, ids[start:], n)
        if n - start <= self.gap:
            self._fill(tail)
            return
        kind = min(self.capacity // (n - start), self.classes)
        pieces = self.open.setdefault(kind, [])
        pieces.append(tail)
        if len(pieces) == kind:
            del self.open[kind]
            self.gaps += self.capacity - sum(len(p[2]) for p in pieces)
            self._short(pieces)

    def finish(self) -> None:
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        for piece in left:
            while piece is not None:
                piece = self._fill(piece)
                if piece is not None:
                    self.short.append(([], self.capacity))
                    self.gap += self.capacity
        while self.short:
            rest, gap = self.short.popleft()
            self.gap -= gap
            self._powers(rest, self.capacity - gap)

    def _powers(self, rest: list[Piece], length: int) -> None:
        """Close pieces of ``length`` ids in all as sequences whose lengths are powers of two."""
        rest = deque(rest)
        while length:
            part = 1 << length.bit_length() - 1
            length -= part
            pieces = []
            while part:
                doc_id, start, ids, doc_tokens = rest.popleft()
                taken = min(part, len(ids))
                pieces.append((doc_id, start, ids[:taken], doc_tokens))
                part -= taken
                if taken < len(ids):
                    rest.appendleft((doc_id, start + taken, ids[taken:], doc_tokens))
            self._close(pieces)


SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


def pack(
    df: DataFrame,
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    end_id: int = END_ID,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all texts of ``df``: a row for each piece, its ids in ``tokens`` (little-endian, 32 bits each).

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its sequence.  Null and empty
    texts are documents of the end id alone; rows with the same or a null id are documents of their own; an empty table
    gives no sequence; other columns of ``df`` are left out.
    """
    path = path or default_vocabulary()

    def run(batches):
        packer = HarmonicPacker(capacity, classes)
        base = TaskContext.get().partitionId() << TASK_BITS
        for batch in rebatch(batches, "text", holds="units"):
            offsets, ids = encode_texts(batch.column("text"), path)
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.empty(offsets[k + 1] - offsets[k] + 1, dtype="<u4")
                own[:-1] = ids[offsets[k] : offsets[k + 1]]
                own[-1] = end_id
                packer.add(doc_id, own)
            yield rows_of(packer, base)
        packer.finish()
        yield rows_of(packer, base)

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def rows_of(packer: HarmonicPacker, base: int) -> pa.RecordBatch:
    doc_ids, starts, ids, doc_tokens, sequences, offsets = zip(*packer.rows) if packer.rows else [()] * 6
    packer.rows = []
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(map(len, ids), pa.int64()),
            pa.array((x.tobytes() for x in ids), pa.binary()),
            pa.array(doc_tokens, pa.int64()),
            pa.array((base + s for s in sequences), pa.int64()),
            pa.array(offsets, pa.int64()),
        ],
        ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"],
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("tokens").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return digest(pack(read_table(spark, sf_dir, "documents")))
