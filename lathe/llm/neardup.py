"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

A document's set holds its different shingles of five words.  One permutation of the shingles deals them to bins; each
bin keeps its least value, and an empty bin takes that of the first non-empty one in a fixed random order of its own
(optimal densification).  Bands of bins are hashed to buckets.

Documents with equal sets (by 128 bits of a hash of the set) are one node from the start.  A bucket's candidates form a star: every member with one centre,
so a bucket of n nodes gives n - 1 pairs.  All candidates are confirmed on full sets of freshly cut shingles, and
confirmed links joined to components.  Members that a star leaves in different components are dealt with exactly: the
Jaccard distance is a metric, so nodes at distances d and e from the centre are at least ``abs(d - e)`` apart, which
rules out most pairs unseen.  Of buckets with the same members one is kept.  What is left of a bucket of at most
``Settings.block`` members and ``block_chars`` characters goes to one task, which counts the shingles that members outside the largest component share
with all others from an inverted list, and gives the links between components.  Larger buckets get further stars around
members outside the largest component, twice as many in each round, until they are as small, or in one component, or all
such members have been centres.  Nothing is capped.

With 64 bands of 6 bins a pair of likeness 0.75 shares no bucket with probability 4e-6.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import encode_words, ragged_take, read_table, rebatch, tune
from lathe.llm.components import components
from lathe.llm.shared import written

#: Stands for a null id where ids are compared.
NO_ID = -(2**63)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    likeness: int = 75  # in hundredths
    bands: int = 64
    rows: int = 6
    #: Centres of a bucket in the second round; their number doubles from round to round, so the rounds are few.
    stars: int = 32
    #: Members of a bucket that one task takes at once, and characters of their texts (which are in memory).
    block: int = 5000
    block_chars: int = 64 << 20
    #: Members from which a bucket is large: its rows stay where they are, and what they are joined with is sent to them
    #: if it has at most ``few`` rows (of 32 bytes at most).
    large: int = 1000
    few: int = 100_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Each text's different shingles as sorted 64-bit hashes; with fewer words, the whole sequence; without, none."""
    offsets, codes, units = encode_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, count=len(units))
    word = hashes[codes]
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        rolled = np.full(max(0, len(word) - words + 1), np.uint64(words))
        for k in range(words):
            rolled = _mix((rolled ^ word[k : len(word) - words + 1 + k]) * _MULT)
    out = []
    for start, n in zip(offsets[:-1].tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(rolled[start : start + n - words + 1]))
        elif n:
            one = np.array([n], np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    one = _mix((one ^ word[start + k]) * _MULT)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """A set's name of 128 bits, as two signed numbers."""
    name = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (name >> 64) - 2**63, (name & (2**64 - 1)) - 2**63


@lru_cache(maxsize=2)
def _orders(bins: int) -> np.ndarray:
    """For each bin, the rank of every bin in its own random order."""
    rng = np.random.default_rng(bins)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a set that is not empty, densified."""
    x = np.sort(_mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    place = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    full, least = place[first], x[first]
    out = np.zeros(bins, np.uint64)
    out[full] = least
    if len(full) < bins:
        empty = np.ones(bins, dtype=bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        donors = _orders(bins)[empty][:, full].argmin(axis=1)
        out[empty] = least[donors]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A signed 64-bit bucket name for each band."""
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MULT
    for k in range(rows.shape[1]):
        with np.errstate(over="ignore"):
            key = _mix((key ^ rows[:, k]) * _MULT)
    return key.view(np.int64)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tune(df.sparkSession)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, other, bands) of each document; the last three null for an empty set.

    ``node`` and ``other`` are the two halves of the set's name.
    """

    def run(batches):
        for batch in rebatch(batches, "text"):
            sets = shingle_sets(batch.column("text"), settings.words)
            names = [node_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    pa.array(
                        [band_keys(signature(s, settings.bins), settings.bands) if len(s) else None for s in sets],
                        pa.list_(pa.int64()),
                    ),
                ],
                ["doc_id", "text_key", "n_shingles", "node", "other", "bands"],
            )

    schema = "doc_id long, text_key long, n_shingles long, node long, other long, bands array<long>"
    return docs.mapInArrow(run, schema)


def told_apart(sigs: DataFrame) -> DataFrame:
    """``sigs`` with new nodes for sets whose names agree in their first half alone, so that a node is one set."""
    clash = sigs.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x != y")
    clash = written(clash.select("node", "x"), "clashes")
    if clash.isEmpty():
        return sigs
    found = sigs.join(clash, "node", "left").withColumn(
        "node", F.when(F.col("other") != F.col("x"), F.xxhash64("node", "other")).otherwise(F.col("node"))
    )
    return written(found.select(sigs.columns), "signatures")


def _packed_texts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in rebatch(batches, "text"):
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = [pack(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def _unpack(packed: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(p).decode() for p in packed.to_pylist()], pa.string())


def confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Full-set comparison of ``pairs`` (a, b): (a, b, common, total) from sets cut out of both texts."""
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("right"))

    def run(batches):
        for batch in rebatch(batches, "left"):
            right_raw, right_of = np.unique(batch.column("b").to_numpy(), return_index=True)
            where = np.searchsorted(right_raw, batch.column("b").to_numpy())
            centres = shingle_sets(_unpack(batch.column("right").take(pa.array(right_of))), settings.words)
            sets = shingle_sets(_unpack(batch.column("left")), settings.words)
            common = [
                len(np.intersect1d(s, centres[k], assume_unique=True)) for s, k in zip(sets, where.tolist())
            ]
            total = [len(s) + len(centres[k]) - c for s, k, c in zip(sets, where.tolist(), common)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
                ["a", "b", "common", "total"],
            )

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long, common long, total long")


def near_links(docs: DataFrame, sigs: DataFrame, settings: Settings) -> DataFrame | None:
    """(node, component) of every node that is linked with another; None if no two nodes share a bucket.

    ``docs`` has doc_id and text, ``sigs`` is ``signed`` of it, as a table.
    """
    nodes = (
        sigs.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.first("bands").alias("bands"))
    )
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(_in_buckets(spread, shared, settings), "buckets")
    if buckets.isEmpty():
        return None
    members = buckets.select("node").distinct()
    least = sigs.groupBy("node").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"), F.first("other").alias("other")
    )
    reps = least.join(members, "node")
    wanted = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    wanted = _packed_texts(wanted).join(reps.select(F.col("rep").alias("doc_id"), "node", "other"), "doc_id")
    # Rows with one id may have several texts: those of other nodes go.
    texts = written(_of_node(wanted, settings), "texts")

    linked = lambda rows: rows.filter(F.col("common") * 100 >= F.col("total") * settings.likeness)
    # First each node with the least centre of its buckets.
    pairs = buckets.groupBy("node").agg(F.min("centre").alias("b")).filter("node != b").select(F.col("node").alias("a"), "b")
    found = written(confirmed(pairs, texts, settings), "confirmed")
    links = linked(found).select("a", "b")
    labels = written(components(links), "labels")
    rest, stars = buckets.select("band", "node"), settings.stars
    while True:
        rest = _open_buckets(rest, labels, settings)
        if rest is None:
            return labels
        sizes = rest.join(texts.select("node", "chars"), "node").groupBy("band")
        sizes = written(sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "sizes")
        small = (F.col("n") <= settings.block) & (F.col("chars") <= settings.block_chars)
        more = _block_links(_in_buckets(rest, sizes.filter(small).select("band", "n"), settings), texts, settings)
        rest = written(_in_buckets(rest, sizes.filter(~small).select("band", "n"), settings), "large")
        if rest.isEmpty():
            return _joined(labels, written(more, "links"))
        near, pairs = _stars(rest, stars)
        found = written(confirmed(pairs, texts, settings), "confirmed")
        labels = _joined(labels, written(more.unionByName(linked(found).select("a", "b")), "links"))
        rest, stars = _after_stars(rest, near, found, settings), 2 * stars


def _in_buckets(rows: DataFrame, buckets: DataFrame, settings: Settings, key: str = "band") -> DataFrame:
    """``rows`` (key, ...) of the ``buckets`` (key, n, ...; n members), with the latter's columns but n.

    Rows of large buckets aren't dealt by the key, where one task would get a whole bucket.
    """
    buckets = written(buckets, f"{key}s")
    large = buckets.filter(F.col("n") >= settings.large).drop("n")
    count = large.count()
    if not 0 < count <= settings.few:
        return rows.join(buckets.drop("n"), key)
    others = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    others = others.join(buckets.filter(F.col("n") < settings.large).drop("n"), key)
    return rows.join(F.broadcast(large), key).unionByName(others)


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components with further links."""
    if more.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a != b")
    return written(components(known.unionByName(more)), "labels")


def _block_links(rest: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links that join components within small buckets: (a, b).  ``rest`` has band, node, label."""

    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(_unpack(table.column("packed").combine_chunks()), settings.words)
        nodes = table.column("node").to_pylist()
        pairs = block_links(sets, table.column("label").to_pylist(), settings.likeness)
        return pa.table(
            {
                "a": pa.array([nodes[i] for i, _ in pairs], pa.int64()),
                "b": pa.array([nodes[j] for _, j in pairs], pa.int64()),
            }
        )

    with_texts = rest.join(texts, "node").select("band", "node", "label", "packed")
    return with_texts.groupBy("band").applyInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], labels: list[int], likeness: int) -> list[tuple[int, int]]:
    """Pairs of sets as like as that which join the components in ``labels`` (a spanning forest of them)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    listed, starts = owner[order], np.searchsorted(codes[order], np.arange(len(flat) + 1))
    ends = np.cumsum(sizes)
    root = {label: label for label in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    # Each pair of components has one that is not the largest.
    largest = Counter(labels).most_common(1)[0][0] if labels else None
    for i in range(len(sets)):
        if labels[i] == largest:
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        positions, _ = ragged_take(starts[:-1], np.diff(starts), own)
        common = np.bincount(listed[positions], minlength=len(sets))
        near = np.flatnonzero(common * 100 >= (sizes[i] + sizes - common) * likeness)
        for j in near.tolist():
            x, y = find(labels[i]), find(labels[j])
            if x != y:
                root[x] = y
                found.append((min(i, j), max(i, j)))
    return found


def _of_node(wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, packed, chars) of rows whose text has the node they were joined to, one for each; chars is its length."""

    def run(batches):
        for batch in rebatch(batches, "packed"):
            plain = _unpack(batch.column("packed"))
            sets = shingle_sets(plain, settings.words)
            # The second half of the name tells: a node may have been renamed for its sake.
            same = [len(s) > 0 and node_of(s)[1] == other for s, other in zip(sets, batch.column("other").to_pylist())]
            chars = pc.utf8_length(plain).cast(pa.int64())
            found = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("packed"), chars], ["node", "packed", "chars"])
            yield found.filter(pa.array(same, pa.bool_()))

    own = wanted.select("node", "other", "packed").mapInArrow(run, "node long, packed binary, chars long")
    return own.dropDuplicates(["node"])


def _open_buckets(rest: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame | None:
    """Buckets whose members are in several components, with these: (band, node, label)."""
    named = rest.join(labels.select("node", "component"), "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("label")
    )
    several = named.groupBy("band").agg(
        F.min("label").alias("x"),
        F.max("label").alias("y"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"),
    )
    several = several.filter("x != y").groupBy("n", "members").agg(F.min("band").alias("band"))
    table = written(_in_buckets(named, several.select("band", "n"), settings), "open")
    return None if table.isEmpty() else table


def _stars(rest: DataFrame, stars: int) -> tuple[DataFrame, DataFrame]:
    """Each open bucket's centres (band, centre, own, first), outside its largest component, and pairs to test.

    The first centre is tested with all members, further ones with those of other components.
    """
    counts = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    others = rest.join(largest, "band").filter(F.col("label") != F.col("largest"))
    centres = others.groupBy("band", F.pmod(F.col("node"), F.lit(stars)).alias("part")).agg(
        F.min_by(F.struct(F.col("node").alias("centre"), F.col("label").alias("own")), "node").alias("c")
    )
    first = others.groupBy("band").agg(F.min("node").alias("least"))
    centres = centres.select("band", "c.*").join(first, "band")
    near = written(centres.select("band", "centre", "own", (F.col("centre") == F.col("least")).alias("first")), "centres")
    pairs = rest.join(near, "band").filter(
        (F.col("node") != F.col("centre")) & (F.col("first") | (F.col("label") != F.col("own")))
    )
    return near, pairs.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()


def _after_stars(rest: DataFrame, near: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """What is left of open buckets: without the centres, and without members that the first centre's distances clear.

    A member linked with the first centre stays only if its distance allows a link with one that is not.
    """
    first = near.filter("first").select("band", F.col("centre").alias("c"))
    far = found.select("a", "b", (1 - F.col("common") / F.col("total")).alias("d"))
    at = rest.join(first, "band").filter(F.col("node") != F.col("c")).withColumn("a", F.greatest("node", "c"))
    at = at.withColumn("b", F.least("node", "c")).join(far, ["a", "b"]).select("band", "node", "d")
    limit = 1 - settings.likeness / 100
    off = at.filter(F.col("d") > limit + 1e-9).groupBy("band").agg(F.min("d").alias("least"))
    stay = at.join(off, "band").filter((F.col("d") > limit + 1e-9) | (F.col("d") >= F.col("least") - limit - 1e-9))
    return stay.select("band", "node").join(
        near.select("band", F.col("centre").alias("node")), ["band", "node"], "left_anti"
    )


def find_near_duplicates(
    df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of near duplicates: doc_id, text_key, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links, a document's own among them; ``kept`` is true where it is
    the document's own.  Null and empty texts have empty sets and are linked with nothing.  Rows with one id are nodes of
    their own unless their sets are equal.  A null id counts for nothing in a class with other ids, and otherwise is the
    class's.  An empty table gives an empty one; other columns of ``df`` are left out.  ``text_key`` tells rows with one
    id apart.
    """
    named = _classes(df, settings, id_col, text_col)
    linked = named.filter(F.col("label").isNotNull())
    least = linked.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    alone = named.filter(F.col("label").isNull()).withColumn("least", F.lit(None).cast("long"))
    return _in_buckets(linked, least, settings, "label").unionByName(alone).select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _classes(df: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, label) of each row, as a table; label names its class, null for an empty set."""
    docs = _keyed(df, id_col, text_col)
    sigs = told_apart(written(signed(docs, settings), "signatures"))
    labels = near_links(docs, sigs, settings)
    own = sigs.select("doc_id", "text_key", "n_shingles", "node")
    if labels is None:
        named = own.withColumn("label", F.col("node"))
    else:
        named = own.join(labels.select("node", "component"), "node", "left").select(
            own.columns + [F.coalesce("component", "node").alias("label")]
        )
    return written(named, "classes")


def keep_one(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df``, with all its columns, for each class of near duplicates; rows with empty sets all stay.

    Of a class the row with the least id stays (null ids last), then that with the least text key.
    """
    named = _classes(df, settings, id_col, text_col).filter(F.col("label").isNotNull())
    rows = named.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("text_key").alias("z"))
    first = rows.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    verdicts = _in_buckets(rows, first, settings, "label")
    verdicts = written(verdicts.withColumn("stays", order == F.col("first")), "verdicts")
    names = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    gone, several = verdicts.filter("not stays").select(names), verdicts.filter("stays and n > 1").select(names)
    same = df[id_col].cast("long").eqNullSafe(F.col("_id")) & (
        F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) == F.col("_key")
    )
    rest = df.join(gone, same, "left_anti")
    if several.isEmpty():
        return rest
    # Equal rows by id and text: one of them stays.
    single = df.join(several, same).dropDuplicates(["_id", "_key"])
    return rest.join(several, same, "left_anti").unionByName(single.select([single[c] for c in df.columns]))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates among all documents."""
    found = find_near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
