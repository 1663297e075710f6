"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, trained in numpy.

Each word enters as a vector: a learned embedding of the word, how much more often training documents with it are toxic
than others (shrunk towards no difference; the document at hand left out while training), the same for its character
n-grams (largest, smallest and mean), and its spelling (length, capitals, digits, other signs).  The network reads
windows of words in both directions; attention weighs its states; a document's score is that of its worst window.  All
overlapping windows of every whole text are scored.

Different words of a batch are turned into vectors, and these into the gates' inputs, once.  Labels are read for a
bounded sample of labelled documents (``Training.documents``, those whose id has the least hash), from which the held
out ones are barred; scores see nothing but the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import encode_words, id_and_text, ragged_take, read_table, rebatch, tune
from lathe.llm.nets import F32, Adam, glorot, gru_backward, gru_forward, sigmoid

WINDOW, STRIDE = 48, 36
#: Windows scored together, and different words turned into vectors together.
BATCH, WORDS = 2048, 20_000
GRAMS = (3, 4, 5, 6, 7)
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class Training:
    """Bounds of the training: labelled documents, their longest text, characters of texts taken at a time, windows
    of one repeated word, passes, and sizes of the network."""

    documents: int = 6000
    block: int = 500_000
    longest: int = 200_000
    repeated: int = 400
    passes: int = 10
    batch: int = 128
    embed: int = 6
    buckets: int = 4096
    grams: int = 1 << 19
    hidden: int = 10
    shrink: float = 8.0
    rate: float = 0.01
    seed: int = 7


def held_out(id_col) -> F.Column:
    """Documents whose labels no score may know: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class WordTable:
    """Different words as cores (lower case, outer signs stripped), their spelling, and hashed character n-grams."""

    def __init__(self, words: list[str], buckets: int, grams: int):
        cores = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for w in words]
        self.size = len(words)
        text = "\x02" + "\x03\x02".join(cores) + "\x03" if words else ""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, cores), np.int64, count=len(cores)) + 2
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(cores)), lengths)
        mult = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, np.uint64(1099511628211)))
            place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
            whole = codes * power[place]
            sums = np.add.reduceat(whole, ends - lengths) if len(words) else np.zeros(0, np.uint64)
            sums = (sums ^ (sums >> np.uint64(31))) * mult
            self.bucket = (sums >> np.uint64(40)).astype(np.int64) % buckets
            self.word = (sums >> np.uint64(20)).astype(np.int64) % grams
            rows, keys = [], []
            h = np.zeros(len(codes), np.uint64)
            for n in range(1, max(GRAMS) + 1):
                if len(codes) < n:
                    break
                h = h[: len(codes) - n + 1] * np.uint64(1099511628211) + codes[n - 1 :]
                if n in GRAMS:
                    inside = owner[: len(h)] == owner[n - 1 :]
                    mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * mult
                    keys.append((mixed >> np.uint64(33)).astype(np.int64) % grams)
                    rows.append(owner[: len(h)][inside])
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        self.gram, self.gram_row = key[order], row[order]
        self.gram_count = np.bincount(self.gram_row, minlength=len(words))
        raw = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")
        raw_len = np.fromiter(map(len, words), np.int64, count=len(words))
        of = np.repeat(np.arange(len(words)), raw_len)
        share = lambda flag: np.bincount(of[flag], minlength=len(words)) / np.maximum(raw_len, 1)
        upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
        letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 0xC0)
        self.spelling = np.stack(
            [np.log1p(raw_len) / 3, share(upper), share(digit), share(~letter & ~digit)], axis=1
        ).astype(F32)

    def over_grams(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest, smallest and mean of each word's grams' values; 0 where it has none."""
        out = [np.zeros(self.size, F32) for _ in range(3)]
        has = np.flatnonzero(self.gram_count)
        if len(has):
            starts = (np.cumsum(self.gram_count) - self.gram_count)[has]
            own = value[self.gram]
            out[0][has] = np.maximum.reduceat(own, starts)
            out[1][has] = np.minimum.reduceat(own, starts)
            out[2][has] = np.add.reduceat(own, starts) / self.gram_count[has]
        return out[0], out[1], out[2]


class ToxicNet:
    """The trained network; ``score`` gives each text's probability."""

    FEATURES = 8

    def __init__(self, texts: list[str], labels: np.ndarray, training: Training = Training()):
        self.t = training
        self.base = float((labels.sum() + 0.5) / (len(labels) + 5)) if len(labels) else 0.05
        self.p: dict[str, np.ndarray] | None = None
        if 0 < labels.sum() < len(labels):
            self._fit(texts, labels.astype(np.int64))

    def _odds(self, toxic: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log odds of toxic documents among those with a word or gram, shrunk to the base rate."""
        k, base = self.t.shrink, self.base
        rate = (toxic + k * base) / (count + k)
        return (np.log(rate / (1 - rate + 1e-9)) - np.log(base / (1 - base))).astype(F32)

    def _blocks(self, texts: list[str]):
        """Documents a few at a time, so that memory is bounded: (first, offsets, codes, table of different words)."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) < self.t.block):
                size += len(texts[stop])
                stop += 1
            offsets, codes, words = encode_words(pa.array(texts[start:stop], pa.string()))
            yield start, offsets, codes, WordTable(words, self.t.buckets, self.t.grams)
            start = stop

    def _fit(self, texts: list[str], labels: np.ndarray) -> None:
        t = self.t
        self.word_count, self.word_toxic, self.gram_count, self.gram_toxic = (np.zeros(t.grams, F32) for _ in range(4))
        for first, offsets, codes, table in self._blocks(texts):
            starts = np.cumsum(table.gram_count) - table.gram_count
            for k in range(len(offsets) - 1):
                # A document counts once for each of its words and grams.
                own = np.unique(codes[offsets[k] : offsets[k + 1]])
                words = np.unique(table.word[own])
                grams = np.unique(table.gram[ragged_take(starts, table.gram_count, own)[0]])
                self.word_count[words] += 1
                self.gram_count[grams] += 1
                if labels[first + k]:
                    self.word_toxic[words] += 1
                    self.gram_toxic[grams] += 1
        self._final()
        inputs, buckets, lengths = [], [], []
        rng = np.random.default_rng(t.seed)
        clean = np.flatnonzero(labels == 0)
        repeated = set(clean[:: max(1, len(clean) // t.repeated)].tolist())
        extra = []
        for first, offsets, codes, table in self._blocks(texts):
            # The document at hand is left out of its own counts, so what it alone holds tells nothing.
            out = [self._features(table, label, 1) for label in (0, 1)]
            plain = self._features(table)
            for k in range(len(offsets) - 1):
                own = codes[offsets[k] : offsets[k + 1]]
                begin = self._worst(plain[own, 0] + plain[own, 1]) if len(own) else 0
                piece = own[begin : begin + WINDOW]
                x = np.zeros((WINDOW, self.FEATURES), F32)
                x[: len(piece)] = out[labels[first + k]][piece]
                b = np.full(WINDOW, t.buckets, np.int64)
                b[: len(piece)] = table.bucket[piece]
                inputs.append(x), buckets.append(b), lengths.append(len(piece))
                if first + k in repeated and len(piece):
                    # A word said over and over is no more toxic than said once.
                    word = rng.choice(piece)
                    extra.append((np.repeat(out[0][word][None], WINDOW, 0), np.full(WINDOW, table.bucket[word])))
        inputs += [x for x, _ in extra]
        buckets += [b for _, b in extra]
        lengths += [WINDOW] * len(extra)
        labels = np.concatenate([labels, np.zeros(len(extra), np.int64)])
        self._train(np.stack(inputs, 1), np.stack(buckets, 1), np.array(lengths), labels)

    @staticmethod
    def _worst(weight: np.ndarray) -> int:
        """Start of the window on the scoring grid with the largest sum of positive weights."""
        starts = window_starts(len(weight))
        sums = np.concatenate(([0.0], np.cumsum(np.maximum(weight, 0))))
        return int(starts[np.argmax(sums[np.minimum(starts + WINDOW, len(weight))] - sums[starts])])

    def _features(self, table: WordTable, label: int = 0, without: int = 0) -> np.ndarray:
        word_n, word_t = np.maximum(self.word_count - without, 0), np.maximum(self.word_toxic - label * without, 0)
        gram_n, gram_t = np.maximum(self.gram_count - without, 0), np.maximum(self.gram_toxic - label * without, 0)
        word = self._odds(word_t[table.word], word_n[table.word])
        most, least, mean = table.over_grams(self._odds(gram_t, gram_n))
        return np.concatenate([np.stack([word, most, least, mean], axis=1), table.spelling], axis=1)

    def _final(self) -> None:
        self.word_odds = self._odds(self.word_toxic, self.word_count)
        self.gram_odds = self._odds(self.gram_toxic, self.gram_count)

    def _train(self, x: np.ndarray, buckets: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> None:
        t = self.t
        rng = np.random.default_rng(t.seed)
        h, d = t.hidden, self.FEATURES + t.embed
        self.p = p = {
            "embed": (rng.standard_normal((t.buckets + 1, t.embed)) * 0.05).astype(F32),
            "wf": glorot(rng, d, 3 * h),
            "uf": glorot(rng, h, 3 * h),
            "bf": np.zeros(3 * h, F32),
            "wb": glorot(rng, d, 3 * h),
            "ub": glorot(rng, h, 3 * h),
            "bb": np.zeros(3 * h, F32),
            "att": (rng.standard_normal(2 * h) * 0.1).astype(F32),
            "out": (rng.standard_normal(2 * h) * 0.1).astype(F32),
            "bias": np.array([np.log(self.base / (1 - self.base))], F32),
        }
        adam = Adam(p, t.rate)
        toxic = np.flatnonzero(labels)
        clean = np.flatnonzero(labels == 0)
        total = t.passes * -(-len(labels) // t.batch)
        for step in range(total):
            adam.rate = t.rate * min(1, 2 * (1 - step / total))
            # A quarter toxic; the loss weighs rows so that scores stay probabilities.
            n_toxic = max(1, t.batch // 4)
            rows = np.concatenate([rng.choice(toxic, n_toxic), rng.choice(clean, t.batch - n_toxic)])
            y = labels[rows].astype(F32)
            weight = np.where(y > 0, self.base / 0.25, (1 - self.base) / 0.75).astype(F32)
            xs, bs = x[:, rows], buckets[:, rows]
            steps, batch = bs.shape
            vec = np.concatenate([xs, p["embed"][bs]], axis=2)
            ahead, kept_f = gru_forward(vec @ p["wf"] + p["bf"], p["uf"], True)
            behind, kept_b = gru_forward((vec @ p["wb"] + p["bb"])[::-1], p["ub"], True)
            both = np.concatenate([ahead, behind[::-1]], axis=2)
            logit, focus, pooled = self._pool(both, lengths[rows])
            delta = (sigmoid(logit) - y) * weight / batch
            d_pooled = delta[:, None] * p["out"]
            d_focus = (both * d_pooled).sum(2)
            d_energy = focus * (d_focus - (focus * d_focus).sum(0))
            d_both = focus[:, :, None] * d_pooled + d_energy[:, :, None] * p["att"]
            dzf, duf = gru_backward(d_both[:, :, :h], p["uf"], kept_f)
            dzb, dub = gru_backward(d_both[::-1, :, h:], p["ub"], kept_b)
            dzb = dzb[::-1]
            cols = vec.reshape(steps * batch, -1).T
            d_vec = (dzf @ p["wf"][self.FEATURES :].T + dzb @ p["wb"][self.FEATURES :].T).reshape(steps * batch, -1)
            d_embed = F32(1e-5) * p["embed"]
            np.add.at(d_embed, bs.ravel(), d_vec)
            adam.update(
                {
                    "embed": d_embed,
                    "wf": cols @ dzf.reshape(steps * batch, -1),
                    "uf": duf,
                    "bf": dzf.sum((0, 1)),
                    "wb": cols @ dzb.reshape(steps * batch, -1),
                    "ub": dub,
                    "bb": dzb.sum((0, 1)),
                    "att": (both * d_energy[:, :, None]).sum((0, 1)),
                    "out": (pooled * delta[:, None]).sum(0),
                    "bias": delta.sum(keepdims=True).astype(F32),
                }
            )

    def _pool(self, both: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        energy = both @ self.p["att"]
        energy = np.where(np.arange(len(both))[:, None] < np.maximum(lengths, 1), energy, F32(-1e9))
        focus = np.exp(energy - energy.max(0))
        focus /= focus.sum(0)
        pooled = np.einsum("tb,tbh->bh", focus, both)
        return pooled @ self.p["out"] + self.p["bias"][0], focus, pooled

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability that each whole text is toxic; nulls are empty."""
        if self.p is None:
            return np.full(len(texts), self.base)
        p = self.p
        offsets, codes, words = encode_words(texts)
        parts = []
        for k in range(0, len(words), WORDS):
            table = WordTable(words[k : k + WORDS], self.t.buckets, self.t.grams)
            odds = np.stack([self.word_odds[table.word], *table.over_grams(self.gram_odds)], axis=1)
            parts.append(np.concatenate([odds, table.spelling, p["embed"][table.bucket]], axis=1))
        x = np.concatenate(parts) if parts else np.zeros((0, self.FEATURES + self.t.embed), F32)
        blank = np.concatenate([np.zeros((1, self.FEATURES), F32), p["embed"][-1:]], axis=1)
        x = np.concatenate([x, blank]).astype(F32)
        zf, zb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        counts = np.diff(offsets)
        per_doc = windows_in(counts)
        owner = np.repeat(np.arange(len(counts)), per_doc)
        first = np.cumsum(per_doc) - per_doc
        starts = (np.arange(len(owner)) - first[owner]) * STRIDE
        lengths = np.minimum(counts[owner] - starts, WINDOW)
        codes = np.append(codes, len(words))
        worst = np.full(len(counts), -np.inf)
        # Windows of like length go together, so that short ones cost no more steps than they have words.
        order = np.argsort(lengths, kind="stable")
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            steps = max(1, int(lengths[rows].max()))
            place = np.arange(steps)[:, None]
            at = np.where(place < lengths[rows], offsets[owner[rows]] + starts[rows] + place, len(codes) - 1)
            word = codes[at]
            both = np.concatenate(
                [gru_forward(zf[word], p["uf"]), gru_forward(zb[word[::-1]], p["ub"])[::-1]], axis=2
            )
            np.maximum.at(worst, owner[rows], self._pool(both, lengths[rows])[0])
        return sigmoid(worst.astype(np.float64))


def windows_in(counts: np.ndarray) -> np.ndarray:
    """Overlapping windows that cover so many words; one for none."""
    return 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))


def window_starts(count: int) -> np.ndarray:
    return np.arange(int(windows_in(np.array([count]))[0])) * STRIDE


def training_rows(
    docs: DataFrame, labels: DataFrame, training: Training, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the bounded sample; never a held-out document's."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    )
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.documents)
    # At most ``training.documents`` rows of 12 bytes are broadcast.
    rows = (
        id_and_text(docs, id_col, text_col)
        .filter(F.length("text") <= training.longest)
        .join(F.broadcast(few), "doc_id")
        .collect()
    )
    rows = sorted(set((r["doc_id"], r["text"], r["toxic"]) for r in rows))[: 2 * training.documents]
    return [r[1] for r in rows], np.array([int(r[2] != 0) for r in rows], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> ToxicNet:
    return ToxicNet(*training_rows(docs, labels, training), training)


def score_texts(
    df: DataFrame, net: ToxicNet, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every whole text of ``df``.

    Null and empty texts are scored as a text without words; repeated rows stay; an empty table gives an empty one;
    without labels of both kinds every text gets the base rate; other columns of ``df`` are left out.
    """

    def run(batches):
        for batch in rebatch(batches, "text"):
            score = net.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(df: DataFrame, net: ToxicNet, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose score is below ``threshold``.

    Null texts score as empty ones do, equal rows alike; an empty table gives an empty one.
    """
    tune(df.sparkSession)

    def run(batches):
        for batch in rebatch(batches, text_col):
            yield batch.filter(pa.array(net.score(batch.column(text_col)) < threshold))

    return df.mapInArrow(run, df.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = read_table(spark, sf_dir, "documents")
    net = train(docs, read_table(spark, sf_dir, "labels"))
    return score_texts(docs, net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
