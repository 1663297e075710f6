"""Files of token ids: patched frame-of-reference blocks with a block index.

A file holds the ids of whole documents in ascending id order (one file for each range of document ids):

    magic ``LATHEPF1``
    blocks: minimum u32, ids u16, width u8, 0 u8, exceptions u16, 0 u16, the low ``width`` bits of each id minus the
        minimum (packed, lowest bit first), then each exception's place u16, then its bits above the width u32
    block index: each block's place in the file u64
    documents: their ids i64, then 1 if the id is known u8, then the number of token ids u64
    footer: blocks u64, documents u64, token ids u64, place of the index u64, place of the documents u64, magic

The width is what the ids at ``PERCENTILE`` need in that block, so some large ids don't widen all others.  Any block can
be read alone through the index.  Numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import id_and_text, read_table, rebatch
from lathe.llm.shared import new_folder
from lathe.llm.tokens import default_vocabulary, encode_texts

MAGIC = b"LATHEPF1"
BLOCK = 1024
PERCENTILE = 90
END_ID = 2
HEAD = struct.Struct("<IHBBHH")
FOOT = struct.Struct("<QQQQQ8s")
#: Blocks packed or read at a time.
RUN = 256


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` ids each; the last may be shorter."""
    whole = len(ids) // BLOCK * BLOCK
    made = _encode_run(ids[:whole].reshape(-1, BLOCK)) if whole else []
    return made + (_encode_run(ids[whole:].reshape(1, -1)) if whole < len(ids) else [])


def _encode_run(rows: np.ndarray) -> list[bytes]:
    rows = rows.astype(np.uint32)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    count = rows.shape[1]
    rank = min(count - 1, count * PERCENTILE // 100)
    common = np.partition(rest, rank, axis=1)[:, rank]
    widths = np.frexp(common.astype(np.float64))[1].astype(np.int64)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        part = rest[which]
        high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        if width:
            raw = part.astype("<u4").view(np.uint8).reshape(len(which), count, 4)
            bits = np.unpackbits(raw[:, :, : (width + 7) // 8], axis=2, bitorder="little")[:, :, :width]
            packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        for k, row in enumerate(which.tolist()):
            places = np.flatnonzero(high[k])
            out[row] = b"".join(
                [
                    HEAD.pack(int(least[row]), count, width, 0, len(places), 0),
                    packed[k].tobytes() if width else b"",
                    places.astype("<u2").tobytes(),
                    high[k, places].astype("<u4").tobytes(),
                ]
            )
    return out


def decode_block(data: bytes) -> np.ndarray:
    least, count, width, _, exceptions, _ = HEAD.unpack_from(data)
    at = HEAD.size
    values = np.zeros((count, 32), dtype=np.uint8)
    if width:
        size = (count * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: count * width]
        values[:, :width] = bits.reshape(count, width)
        at += size
    ids = np.packbits(values, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    if exceptions:
        places = np.frombuffer(data, "<u2", exceptions, at)
        ids[places] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
    return ids + np.uint32(least)


class IdFileWriter:
    """Writes one file front to back; memory is the index and the documents' table."""

    def __init__(self, stream):
        self.stream = stream
        self.place = 0
        self.index: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.left = np.zeros(0, np.uint32)
        self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), RUN * BLOCK):
            for block in encode_blocks(ids[k : k + RUN * BLOCK]):
                self.index.append(self.place)
                self._put(block)

    def add(self, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts += counts
        self.ids += len(ids)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.left = ids[whole:]

    def close(self) -> None:
        self._blocks(self.left)
        index = self.place
        self._put(np.asarray(self.index, dtype="<u8").tobytes())
        docs = self.place
        self._put(np.asarray([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self._put(np.asarray([d is not None for d in self.docs], dtype=np.uint8).tobytes())
        self._put(np.asarray(self.counts, dtype="<u8").tobytes())
        self._put(FOOT.pack(len(self.index), len(self.docs), self.ids, index, docs, MAGIC))


class IdFileReader:
    """Random access to a file's blocks, and its documents in order."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        blocks, n_docs, self.ids, index, docs, magic = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        self.starts = np.append(np.frombuffer(self._at(index, 8 * blocks), "<u8"), np.uint64(index)).astype(np.int64)
        table = self._at(docs, 17 * n_docs)
        known = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        numbers = np.frombuffer(table, "<i8", n_docs).tolist()
        self.docs = [d if k else None for d, k in zip(numbers, known)]
        self.counts = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        data = self.stream.read(size)
        if len(data) != size:
            raise ValueError("the file is cut off")
        return data

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """Ids of some blocks, read at once."""
        if first >= stop:
            return np.zeros(0, np.uint32)
        base = int(self.starts[first])
        data = self._at(base, int(self.starts[stop]) - base)
        spans = zip(self.starts[first:stop] - base, self.starts[first + 1 : stop + 1] - base)
        return np.concatenate([decode_block(data[a:b]) for a, b in spans])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids), a run of blocks in memory at a time."""
        held, base, block, n = np.zeros(0, np.uint32), 0, 0, len(self.starts) - 1
        ends = np.cumsum(self.counts)
        for doc_id, count, end in zip(self.docs, self.counts.tolist(), ends.tolist()):
            parts = [held[end - count - base :]]
            have = len(parts[0])
            while have < count:
                base += len(held)
                stop = min(n, block + RUN)
                if block == stop:
                    raise ValueError("the file has too few ids")
                held = self.blocks(block, stop)
                block = stop
                parts.append(held)
                have += len(held)
            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc_id, end - count, ids[:count]


def write(
    df: DataFrame,
    folder: str,
    end_id: int = END_ID,
    path: str | None = None,
    files: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[str, int, int]]:
    """Write all texts' ids in ascending id order under ``folder``: (file, documents, token ids) of each file in order.

    ``folder`` is one that executors share.  Null ids come first; rows with equal ids are ordered by text; null texts are
    empty and give the end id alone.  A file appears under its name when it is whole, so a task that is run again does
    no harm.  Only a row for each file comes to the driver.
    """
    path = path or default_vocabulary()
    docs = id_and_text(df, id_col, text_col)
    files = files or max(1, docs.rdd.getNumPartitions())

    def run(batches):
        batches = rebatch(batches, "text", holds="units")
        first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name, draft = f"ids-{part:06d}.pfor", f"{place}/.draft-{part:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as stream:
            writer = IdFileWriter(stream)
            batch = first
            while batch is not None:
                offsets, ids = encode_texts(batch.column("text"), path)
                stops = offsets[1:] + np.arange(1, len(offsets))
                own = np.full(len(ids) + len(stops), end_id, dtype=np.uint32)
                inner = np.ones(len(own), dtype=bool)
                inner[stops - 1] = False
                own[inner] = ids
                writer.add(batch.column("doc_id").to_pylist(), np.diff(stops, prepend=0).tolist(), own)
                batch = next(batches, None)
            writer.close()
        store.move(draft, f"{place}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part]), "name": [name], "docs": [len(writer.docs)], "ids": [writer.ids]}
        )

    ordered = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(run, "part long, name string, docs long, ids long").collect()
    return [(r["name"], r["docs"], r["ids"]) for r in sorted(rows, key=lambda r: r["part"])]


def read(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits)."""
    rows, start = [], 0
    for name, _, ids in files:
        rows.append((name, start))
        start += ids
    schema = "name string, start long"
    listed = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))

    def run(batches):
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{place}/{name}") as stream:
                    held, size = [], 0
                    for doc_id, before, ids in IdFileReader(stream).documents():
                        held.append((doc_id, base + before, len(ids), ids.astype("<u4").tobytes()))
                        size += 4 * len(ids)
                        if size > 8 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc_ids, starts, counts, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        ["doc_id", "start", "n_tokens", "ids"],
    )


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as files and read back."""
    folder = new_folder(spark, "id-files")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write(read_table(spark, sf_dir, "documents"), folder)
    return read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
