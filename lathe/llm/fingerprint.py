"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each length, the sum of its code points times powers of a base, modulo a prime.  Any
two spans are compared by two differences, so equality of spans takes constant time and the longest common extension of
two places a binary search.  A fingerprint joins the whole text's hash (modulo two primes) and length with a sketch: the
least of the mixed hashes of all spans of ``SPAN`` code points.  Equal texts have equal fingerprints; the likeness of two
is the share of common spans, repeats counted, that their sketches estimate.

To compare each document with the next in ascending id order, documents go to buckets of a range of ids (bounds from an
approximate quantile summary of the ids alone), with a ghost of each bucket's first document in the bucket before it.
One shuffle of compressed texts, sorted in each partition, then pairs neighbours while streaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import id_and_text, read_table, rebatch

PRIME = np.uint64(2**31 - 1)
PRIME2 = np.uint64(2**31 - 19)
BASE, BASE2 = 911_382_323, 972_663_749
SPAN = 8
SKETCH = 64
#: Code points handled at a time, so temporary arrays stay small for any text.
BLOCK = 1 << 18
#: Buckets for each partition of the input, and at most in all (their bounds and first ids come to the driver).
BUCKETS, MOST_BUCKETS = 4, 100_000


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base by doubling."""
    out = np.ones(n, np.uint64)
    filled, step = 1, base % prime
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(step) % np.uint64(prime)
        filled += take
        step = step * step % prime
    return out


_POWER = _powers(BASE, int(PRIME), BLOCK)
_INVERSE = _powers(pow(BASE, -1, int(PRIME)), int(PRIME), BLOCK)
_POWER2 = _powers(BASE2, int(PRIME2), BLOCK)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


class PrefixHash:
    """Prefix array of a text: hashes of any span, and longest common extensions."""

    def __init__(self, text: str):
        codes = code_points(text)
        self.n = len(codes)
        self.prefix = np.zeros(self.n + 1, np.uint32)
        second, scale, scale2, total = 0, 1, 1, np.uint64(0)
        for at in range(0, self.n, BLOCK):
            part = codes[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
            sums = _mod(np.cumsum(_mod(part * _POWER[: len(part)])))
            if at:
                sums = _mod(_mod(sums * np.uint64(scale)) + total)
            self.prefix[at + 1 : at + 1 + len(part)] = sums
            total = sums[-1]
            own = int((part * _POWER2[: len(part)] % PRIME2).sum() % PRIME2)
            second = (second + own * scale2) % int(PRIME2)
            scale = scale * pow(BASE, BLOCK, int(PRIME)) % int(PRIME)
            scale2 = scale2 * pow(BASE2, BLOCK, int(PRIME2)) % int(PRIME2)
        self.whole = int(self.prefix[-1]) << 31 | second
        self._shown: str | None = None

    def span(self, start: int, end: int) -> int:
        """Hash of a span; equal spans have equal hashes wherever they stand."""
        p = int(PRIME)
        return (int(self.prefix[end]) - int(self.prefix[start])) * pow(BASE, -start, p) % p

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension of two places."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(other_start, other_start + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def sketch(self) -> np.ndarray:
        """The least ``SKETCH`` mixed hashes of all spans (of the whole text, if it is shorter than one).

        A span that repeats counts as often as it does in the whole text.
        """
        if self.n < SPAN:
            return self._mixed(np.array([self.span(0, self.n)], np.uint64)) if self.n else np.zeros(0, np.uint32)
        least = np.zeros(0, np.uint32)
        #: Spans of the blocks before, and how often each occurred.
        known, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for at in range(0, self.n - SPAN + 1, BLOCK):
            stop = min(at + BLOCK, self.n - SPAN + 1)
            ends = self.prefix[at + SPAN : stop + SPAN].astype(np.uint64)
            hashes = _mod((ends + PRIME - self.prefix[at:stop]) * _INVERSE[: stop - at])
            if at:
                hashes = _mod(hashes * np.uint64(pow(BASE, -at, int(PRIME))))
            numbered = self._numbered(hashes)
            if self.n - SPAN + 1 > BLOCK:
                own = numbered & np.uint64(0xFFFFFFFF)
                if len(known):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    before = np.where(known[place] == own, times[place], 0)
                    numbered = numbered + (before.astype(np.uint64) << np.uint64(32))
                new, counts = np.unique(own, return_counts=True)
                known, which = np.unique(np.concatenate([known, new]), return_inverse=True)
                times = np.bincount(which, np.concatenate([times, counts])).astype(np.int64)
            mixed = self._mixed(numbered)
            some = np.unique(np.partition(mixed, 4 * SKETCH)[: 4 * SKETCH]) if len(mixed) > 4 * SKETCH else None
            if some is None or len(some) <= SKETCH:
                some = np.unique(mixed)
            least = np.unique(np.concatenate([least, some[:SKETCH]]))[:SKETCH]
        return least

    @staticmethod
    def _numbered(hashes: np.ndarray) -> np.ndarray:
        """Each hash with its number among equal ones, so that repetition has its weight in the sketch."""
        hashes = np.sort(hashes.astype(np.uint32)).astype(np.uint64)
        place = np.arange(len(hashes))
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        return hashes | (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) << np.uint64(32)

    @staticmethod
    def _mixed(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hashes * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self) -> str:
        """Length, whole hash and sketch in hexadecimal."""
        if self._shown is None:
            self._shown = f"{self.n:x}-{self.whole:016x}-{self.sketch().astype('>u4').tobytes().hex()}"
        return self._shown


def fingerprint(text: str) -> str:
    return PrefixHash(text).fingerprint()


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two fingerprinted texts, from 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), ">u4") for f in (a, b))
    union = np.union1d(x, y)[:SKETCH]
    if not len(union) or not len(x) or not len(y):
        return 0.0
    return float(np.isin(union, x).astype(int) @ np.isin(union, y)) / len(union)


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every whole text of ``df``, without a shuffle.

    Null texts are empty; repeated rows stay; an empty table gives an empty one; other columns of ``df`` are left out.
    """

    def run(batches):
        for batch in rebatch(batches, "text"):
            found = [PrefixHash(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f.n for f in found], pa.int64()),
                    pa.array([f.fingerprint() for f in found], pa.string()),
                ],
                ["doc_id", "n_chars", "fingerprint"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _keys(ids: pa.Array) -> np.ndarray:
    """Ids to sort by; null comes first."""
    return ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in bucket order, each bucket followed by a ghost of the document after it.

    Columns: bucket, ghost, doc_id, packed (the text, compressed).  Within a partition they are sorted so that each
    document's successor comes next.
    """
    ids = docs.select("doc_id")
    count = min(MOST_BUCKETS, BUCKETS * max(1, docs.rdd.getNumPartitions()))
    cuts = [k / count for k in range(1, count)]
    bounds = ids.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * count))).first()[0] if cuts else None
    bounds = np.unique(np.array(bounds or [], np.int64))

    def least(batches):
        for batch in batches:
            keys = _keys(batch.column("doc_id"))
            bucket = np.searchsorted(bounds, keys, side="right")
            order = np.lexsort((keys, bucket))
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][first].astype(np.int32)), pa.array(keys[order][first])], ["bucket", "key"]
            )

    firsts = ids.mapInArrow(least, "bucket int, key long").groupBy("bucket").agg(F.min("key").alias("key")).collect()
    firsts = sorted((r["bucket"], r["key"]) for r in firsts)  # a row for each bucket at most
    before = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}  # the first document follows the last

    def deal(batches):
        for batch in rebatch(batches, "text"):
            keys = _keys(batch.column("doc_id"))
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = [pack(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            bucket = np.searchsorted(bounds, keys, side="right")
            ghosts = np.array([k for k, key in enumerate(keys.tolist()) if key in before], np.int64)
            rows = np.concatenate([np.arange(len(keys)), ghosts])
            targets = [*bucket.tolist(), *(before[int(keys[k])] for k in ghosts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(targets, pa.int32()),
                    pa.array(np.arange(len(rows)) >= len(keys)),
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(packed, pa.binary()).take(pa.array(rows)),
                ],
                ["bucket", "ghost", "doc_id", "packed"],
            )

    dealt = docs.mapInArrow(deal, "bucket int, ghost boolean, doc_id long, packed binary")
    parts = max(1, docs.rdd.getNumPartitions())
    return dealt.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "ghost", F.col("doc_id").asc_nulls_first(), "packed"
    )


def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, PrefixHash, str, PrefixHash]]:
    """Each document with its successor: (id, text, hash, next text, next hash)."""
    held = None
    for batch in batches:
        for bucket, ghost, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held[0] == bucket and held[1] and ghost:
                continue
            text = zstandard.ZstdDecompressor().decompress(packed).decode()
            hashed = PrefixHash(text)
            if held is not None and held[0] == bucket and not held[1]:
                yield held[2], held[3], held[4], text, hashed
            held = (bucket, ghost, doc_id, text, hashed)


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points makes way for the first as many (or all) of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and likenesses, in ascending id order.

    Further columns: code points that the text shares at its start with the edited and with the next one.  Null texts
    are empty; null ids come first; rows with one id follow each other in a fixed order; the last row's next is the
    first; a single row's next is itself; an empty table gives an empty one; other columns are left out.
    """

    def run(batches):
        rows = []
        for doc_id, text, own, following, next_hash in paired(batches):
            changed = edited(text, following)
            other = PrefixHash(changed)
            prints = own.fingerprint(), other.fingerprint(), next_hash.fingerprint()
            rows.append(
                (
                    doc_id,
                    own.n,
                    hashlib.sha256(changed.encode()).hexdigest(),
                    prints[0],
                    prints[1],
                    likeness(prints[0], prints[1]),
                    likeness(prints[0], prints[2]),
                    own.extension(0, other, 0),
                    own.extension(0, next_hash, 0),
                )
            )
            if len(rows) >= 1024:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next shared_edited shared_next"
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 2]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names.split())

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, shared_edited long, shared_next long"
    )
    return neighbours(id_and_text(df, id_col, text_col)).mapInArrow(run, schema)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return compare_neighbours(read_table(spark, sf_dir, "documents"))
