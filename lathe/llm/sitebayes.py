"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model of a text's make-up, fitted to labelled documents, gives each document's evidence (its log odds less
those of the prior).  Documents' own probabilities are summed for each path and host in one grouped aggregation.  A
host's rate is shrunk towards the global one and a path's towards its host's, with strengths that the moments of the
rates themselves give (a prior as strong as sites are alike): sites with few documents say little.  A document's
posterior joins its evidence with its path's rate, its own share taken out first.

Only a row of moments comes to the driver; site tables stay distributed, and Spark broadcasts one only below its own
size limit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import encode_words, id_and_text, read_table, rebatch, tune
from lathe.llm.quality import duplicate_lines, repeated_words
from lathe.llm.shared import written
from lathe.llm.toxicity import held_out

#: Bytes of text taken at a time: each has some numbers of its own.
BLOCK = 2 << 20
#: Posterior from which a document is kept.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Training:
    """Bounds of the training: labelled documents (least hashes first) and their longest text; the ridge's weight."""

    documents: int = 4000
    longest: int = 200_000
    ridge: float = 1.0
    steps: int = 25


def _classes() -> np.ndarray:
    table = np.full(256, 8, np.int64)  # bytes of other characters
    table[:128] = 7
    groups = (range(97, 123), range(65, 91), range(48, 58), [32, 9, 11, 12, 13], [10], b".,;:'\"?-", b"#*$%&|<>", [33])
    for k, group in enumerate(groups):
        table[list(group)] = k if k < 7 else 9
    return table


_CLASS = _classes()
N_CLASSES = 10


def make_up(texts: pa.Array) -> np.ndarray:
    """Features of whole texts: shares of byte classes, words, their length and repetition, repeated lines."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), sizes)
    shares = np.bincount(doc * N_CLASSES + _CLASS[raw], minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES)
    shares = shares / np.maximum(sizes, 1)[:, None]
    words, codes, _ = encode_words(texts)
    n = np.diff(words)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(texts)), n)
    different = np.bincount(
        np.unique(owner * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1),
        minlength=len(texts),
    )
    lines = np.fromiter((duplicate_lines(t) for t in texts.to_pylist()), np.float64, count=len(texts))
    return np.column_stack(
        [
            np.sqrt(shares),
            np.log1p(n),
            np.log1p(sizes / some),
            different / some,
            repeated_words(words, codes) / some,
            np.log1p(lines),
        ]
    )


class Evidence:
    """Ridge logistic regression on standardised features, by Newton's method."""

    def __init__(self, texts: list[str], labels: np.ndarray, training: Training = Training()):
        self.prior = float((labels.sum() + 1) / (len(labels) + 2))
        self.weights = None
        if not 0 < labels.sum() < len(labels):
            return
        x = np.concatenate([make_up(pa.array(texts[k : k + 200], pa.string())) for k in range(0, len(texts), 200)])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], training.ridge)
        ridge[-1] = 1e-6
        for _ in range(training.steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hess, x.T @ (labels - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """Evidence of each text: its log odds without the prior's; at most 12 either way."""
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.clip((make_up(texts) - self.mean) / self.scale, -6, 6)
        odds = x @ self.weights[:-1] + self.weights[-1] - np.log(self.prior / (1 - self.prior))
        return np.clip(odds, -12, 12)


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Evidence:
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("good"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("good").isNotNull() & ~held_out(F.col("doc_id")))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.documents)
    # At most ``training.documents`` rows of 12 bytes are broadcast.
    rows = id_and_text(docs).filter(F.length("text") <= training.longest).join(F.broadcast(few), "doc_id").collect()
    rows = sorted(set((r["doc_id"], r["text"], r["good"]) for r in rows))
    return Evidence([r[1] for r in rows], np.array([float(r[2] != 0) for r in rows]), training)


def _strength(sums: DataFrame, total: str, count: str, mean: F.Column) -> DataFrame:
    """Moments of the rates of sites around ``mean``: the prior's strength in documents."""
    rate = F.col(total) / F.col(count)
    enough = F.col(count) >= 2
    between = F.sum(F.when(enough, F.col(count) * F.pow(rate - mean, F.lit(2))))
    return sums.agg(between.alias("between"), F.sum(F.when(enough, F.col(count))).alias("n"), F.count(F.when(enough, 1)).alias("k"))


def _beta_strength(row, mean: float) -> float:
    """Prior documents by the method of moments, between 1 and 10,000."""
    if not row["k"] or row["k"] < 2:
        return 10.0
    within = mean * (1 - mean)
    spread = max(0.0, (row["between"] - (row["k"] - 1) * within) / max(1.0, row["n"] - row["n"] / row["k"]))
    return float(min(10_000.0, max(1.0, within / spread - 1 if spread > 0 else 10_000.0)))


def classify(
    df: DataFrame,
    evidence: Evidence,
    host_col: str = "source",
    path_col: str | None = "lang",
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, evidence (log odds), host_rate, path_rate, score (posterior) and kept of every whole text of ``df``.

    Null hosts and paths are sites of their own, as is the empty one; null and empty texts are judged by their lack of
    words and their site; repeated rows stay and count as often; an empty table gives an empty one; without labels of
    both kinds all evidence is 0; other columns of ``df`` are left out.
    """
    tune(df.sparkSession)
    site = lambda c: F.coalesce(df[c].cast("string"), F.lit("\x00")) if c and c in df.columns else F.lit("")

    def run(batches):
        for batch in rebatch(batches, "text", BLOCK):
            found = evidence.log_odds(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(found)],
                ["doc_id", "host", "path", "evidence"],
            )

    prior = float(np.log(evidence.prior / (1 - evidence.prior)))
    own = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
        site(host_col).alias("host"),
        site(path_col).alias("path"),
    )
    docs = written(own.mapInArrow(run, "doc_id long, host string, path string, evidence double"), "evidence")
    docs = docs.withColumn("own", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior)))))
    paths = docs.groupBy("host", "path").agg(F.sum("own").alias("sum"), F.count(F.lit(1)).alias("n"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("host_sum"), F.sum("n").alias("host_n"))
    total = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    mean = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    host_k = _beta_strength(_strength(hosts, "host_sum", "host_n", F.lit(mean)).first(), mean)
    both = paths.join(hosts, "host")
    path_k = _beta_strength(
        _strength(both, "sum", "n", F.col("host_sum") / F.col("host_n")).first(), mean
    )
    # Rates without the document at hand: its own evidence enters once.
    host_rate = (F.col("host_sum") - F.col("own") + host_k * mean) / (F.col("host_n") - 1 + host_k)
    path_rate = (F.col("sum") - F.col("own") + path_k * F.col("host_rate")) / (F.col("n") - 1 + path_k)
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        docs.join(both, ["host", "path"])
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate))))))
        .select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))
    )


def op5_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document.

    ``documents`` has no path: its language within its source stands in for one, so ``path_rate`` is a language's rate.
    """
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, train(docs, read_table(spark, sf_dir, "labels")))
