"""Arrow batches of texts: bounded regrouping, exact ASCII word splitting, dictionary-encoded words.

Every operator works through ``mapInArrow``.  A batch is regrouped so that it holds about ``TARGET_BYTES`` of text, so
memory is bounded by that plus the longest single text, whatever the number of rows Spark hands over at once.

Spark gives a worker to the tasks of one operator after another.  So a task that has read its last batch gives the memory
it no longer needs back to the system, and what a worker holds for one operator goes when a task of another begins.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 4 << 20
#: Rows per Arrow batch between the JVM and Python: small, as one row may hold a very long text.
ARROW_ROWS = 1024


#: What a worker holds from task to task, by name, with the call that lets go of it.
HELD: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Free memory, Arrow's and the C library's, goes back to the system (where the library can do that)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def tune(spark: SparkSession) -> None:
    """Lower the session's Arrow batch length to ``ARROW_ROWS`` (never raise it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty), so that no other column of ``df`` can clash."""
    tune(df.sparkSession)
    return df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    )


def rebatch(
    batches: Iterable[pa.RecordBatch], column: str, target: int = TARGET_BYTES, holds: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Regroup into batches of about ``target`` bytes of ``column``; a longer single row comes alone.

    Of what the worker holds (``HELD``) only ``holds`` stays.
    """
    for name, let_go in HELD.items():
        if name != holds:
            let_go()
    try:
        yield from _regrouped(batches, column, target)
    finally:
        give_back()


def _regrouped(batches: Iterable[pa.RecordBatch], column: str, target: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(lengths)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, before + target - size, side="right"))
            stop = max(stop, start + (0 if held else 1))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                before, start = int(ends[stop - 1]), stop
            if start < batch.num_rows or size >= target:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^ \\t-\\r]+`` of each text: (offsets of length n + 1, flat words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate(([0], np.cumsum(full)))
    if not full.all():
        flat = flat.filter(pa.array(full))
    return before[offsets - offsets[0]].astype(np.int64), flat


def encode_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``split_words``, with the words as codes into a list of different words."""
    offsets, flat = split_words(texts)
    coded = flat.dictionary_encode()
    return offsets, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def ragged_take(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of ``which`` one after another, and the offsets of each."""
    n = lengths[which]
    offsets = np.concatenate(([0], np.cumsum(n)))
    positions = np.repeat(starts[which] - offsets[:-1], n) + np.arange(offsets[-1])
    return positions, offsets
