"""Quality rules: base counts, and tokeniser fertility within bands for each language or script.

A public vocabulary with byte fallback cuts each whole text into tokens.  Three measures follow: characters of words per
token, the share of tokens that are bytes the vocabulary fell back to, and the entropy of the document's tokens.  Text of the language it claims to be lies in a band of each measure; spam of
symbols, shouted capitals, mojibake and repetition lie outside.  The vocabulary never joins text across white space, so
each different word of a batch is cut once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import encode_words, ragged_take, read_table, rebatch, tune


@dataclass(frozen=True)
class Band:
    """Limits of characters per token and byte share, and the least entropy of a text's tokens in bits.

    Entropy grows with the number of tokens n until the vocabulary in use is spent, so its limit is
    ``a + b * x + c * x * x - slack`` with x = log2(n), at most ``MOST_LOG``.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    entropy: tuple[float, float, float]
    slack: float

    def least_entropy(self, n_tokens: int) -> float:
        a, b, c = self.entropy
        x = min(math.log2(max(n_tokens, 1)), MOST_LOG)
        return a + b * x + c * x * x - self.slack - (SHORT_SLACK if n_tokens < SHORT else 0)

    def holds(self, chars: float, share: float, entropy: float, n_tokens: int) -> bool:
        wider = SHORT_WIDER if n_tokens < SHORT else 1.0
        return (
            self.least_chars / wider <= chars <= self.most_chars * wider
            and share <= self.most_bytes * wider
            and entropy >= self.least_entropy(n_tokens)
        )


#: Where a language's entropy curve levels off.
MOST_LOG = 11.0
#: Bands by language, then by script for texts whose language has none.  Fertility below a band means that the
#: vocabulary had to spell the text out, above it that long pieces (rulers, padding) repeat; entropy below it that a few
#: tokens (symbols, markup, shouted words in pieces) take the place of prose.  The curves follow
#: ordinary prose: over the documents of sf0.1 that are kept, a language's median distance from its curve is 0.01 to 0.05
#: bits, and 0.64 bits at most below it.
BANDS = {
    "en": Band(1.30, 8.0, 0.05, (0.64, 1.06, -0.0446), 0.5),
    "de": Band(1.20, 8.0, 0.08, (1.04, 0.97, -0.0414), 0.65),
    "fr": Band(1.20, 8.0, 0.08, (1.38, 0.90, -0.0381), 0.45),
    "es": Band(1.20, 8.0, 0.08, (0.65, 1.05, -0.0449), 0.45),
    "latin": Band(1.10, 9.0, 0.15, (0.64, 1.00, -0.0446), 1.5),
    "other": Band(0.25, 9.0, 0.95, (0.64, 1.00, -0.0446), 3.0),
}
#: Texts with fewer tokens than this have wider bands, as their measures vary more: limits of characters and bytes by this
#: factor, of entropy by these bits.
SHORT, SHORT_WIDER, SHORT_SLACK = 32, 1.5, 0.6
#: A share of Latin letters among all non-space characters that makes a text's script Latin.
LATIN_SHARE = 0.5

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_FIRST = np.ones(256, dtype=bool)  # bytes that begin a code point
_FIRST[0x80:0xC0] = False
_LATIN = np.zeros(256, dtype=bool)  # ASCII letters, and lead bytes of U+00C0 to U+024F
_LATIN[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = True
_LINE_SPACES = " \t\n\x0b\x0c\r"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load_pieces(path: str):
    """The vocabulary, and which of its ids are bytes."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return pieces, np.array([pieces.IsByte(k) for k in range(pieces.GetPieceSize())])


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags between each two offsets."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def character_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in words, symbols and Latin letters of each text, straight from the UTF-8 buffer."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return (
        _sums((_FIRST & ~_SPACES)[raw], offsets),
        _sums(_SYMBOLS[raw], offsets),
        _sums(_LATIN[raw], offsets),
    )


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_LINE_SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(offsets: np.ndarray, codes: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in that text."""
    n = len(codes)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(np.arange(n) + width <= offsets[doc + 1]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    mixed = np.random.default_rng(5).integers(1, 2**63, size=max(int(codes.max()), int(doc[-1])) + 1, dtype=np.uint64)
    word = mixed[codes]
    with np.errstate(over="ignore"):
        key = mixed[doc[starts]]
        for k in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + word[starts + k]
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    found = starts[twice]
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, offsets)


def fertility(offsets: np.ndarray, codes: np.ndarray, words: list[str], path: str) -> tuple[np.ndarray, ...]:
    """Tokens, bytes among them, and the entropy of tokens (bits) of each text."""
    n_docs = len(offsets) - 1
    pieces, is_byte = load_pieces(path)
    encoded = pieces.encode(words, num_threads=1) if words else []
    lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
    flat = np.fromiter((i for x in encoded for i in x), dtype=np.int32, count=int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    bytes_in = np.add.reduceat(np.append(is_byte[flat], False).astype(np.int64), starts) if len(flat) else lengths
    bytes_in = np.where(lengths > 0, bytes_in, 0)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    tokens = np.bincount(doc, weights=lengths[codes], minlength=n_docs).astype(np.int64)
    fallen = np.bincount(doc, weights=bytes_in[codes], minlength=n_docs).astype(np.int64)
    positions, _ = ragged_take(starts, lengths, codes)
    key = np.repeat(np.arange(n_docs, dtype=np.int64), tokens) * len(is_byte) + flat[positions]
    key.sort()
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(edges, len(key)))
    of = key[edges] // len(is_byte)
    plogp = np.bincount(of, weights=count * np.log2(np.maximum(count, 1)), minlength=n_docs)
    entropy = np.where(tokens > 0, np.log2(np.maximum(tokens, 1)) - plogp / np.maximum(tokens, 1), 0.0)
    return tokens, fallen, entropy


def measure(texts: pa.Array, path: str) -> dict[str, np.ndarray]:
    """All counts and measures of whole texts."""
    offsets, codes, words = encode_words(texts)
    chars, symbols, latin = character_counts(texts)
    tokens, fallen, entropy = fertility(offsets, codes, words, path)
    some = np.maximum(tokens, 1)
    return {
        "n_words": np.diff(offsets),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.fromiter(
            (duplicate_lines(t or "") for t in texts.to_pylist()), dtype=np.int64, count=len(texts)
        ),
        "n_repeat_words": repeated_words(offsets, codes),
        "n_tokens": tokens,
        "chars_per_token": chars / some,
        "byte_share": fallen / some,
        "entropy": entropy,
        "latin_share": latin / np.maximum(chars, 1),
    }


def verdicts(found: dict[str, np.ndarray], langs: list[str | None], bands: dict[str, Band]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    words = found["n_words"]
    base = (words < 10) | (100 * found["n_repeat_words"] > 20 * words)
    script = np.where(found["latin_share"] >= LATIN_SHARE, "latin", "other")
    limits = [bands.get(lang or "") or bands[s] for lang, s in zip(langs, script.tolist())]
    within = np.fromiter(
        (
            b.holds(c, share, e, n)
            for b, c, share, e, n in zip(
                limits,
                found["chars_per_token"].tolist(),
                found["byte_share"].tolist(),
                found["entropy"].tolist(),
                found["n_tokens"].tolist(),
            )
        ),
        dtype=bool,
        count=len(words),
    )
    return base, ~base & within


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DOUBLES = ("chars_per_token", "byte_share", "entropy")


def assess(
    df: DataFrame,
    bands: dict[str, Band] | None = None,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """Counts, measures and verdict of every text of ``df``.

    Null and empty texts have no words and fail the base rule; a null, unknown or absent language is judged by script;
    repeated rows stay; an empty table gives an empty one; other columns of ``df`` are left out.
    """
    path, bands = path or default_vocabulary(), bands or BANDS
    tune(df.sparkSession)
    lang = df[lang_col].cast("string") if lang_col and lang_col in df.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in rebatch(batches, "text"):
            found = measure(batch.column("text"), path)
            base, kept = verdicts(found, batch.column("lang").to_pylist(), bands)
            names = [*LONGS, "n_tokens", *DOUBLES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[k]) for k in names), pa.array(base), pa.array(kept)],
                ["doc_id", *names, "base_failed", "kept"],
            )

    schema = ", ".join(
        ["doc_id long", *(f"{k} long" for k in (*LONGS, "n_tokens")), *(f"{k} double" for k in DOUBLES)]
    )
    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), lang.alias("lang"))
    return own.mapInArrow(run, f"{schema}, base_failed boolean, kept boolean")


def keep_good(
    df: DataFrame,
    bands: dict[str, Band] | None = None,
    path: str | None = None,
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text is kept.

    Null and empty texts are not (they have too few words); equal rows have one verdict; an empty table gives an empty one.
    """
    path, bands = path or default_vocabulary(), bands or BANDS
    tune(df.sparkSession)
    lang_col = lang_col if lang_col in df.columns else None

    def run(batches):
        for batch in rebatch(batches, text_col):
            langs = batch.column(lang_col).to_pylist() if lang_col else [None] * batch.num_rows
            kept = verdicts(measure(batch.column(text_col), path), langs, bands)[1]
            yield batch.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return assess(read_table(spark, sf_dir, "documents"))
