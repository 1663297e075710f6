"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has exactly one last token in its BPE encoding.  It is the one vocabulary token that ends
there (found with a suffix automaton of the vocabulary, which lists every token that is a suffix of the prefix read so
far), whose start is a prefix with a last token, and that is compatible with that last token.  Two tokens are compatible
when BPE, given the symbols of both, would merge nothing across their border.  The whole encoding follows from the back
pointers.  Work is linear in the text for a bounded token length, and no merge queue is needed.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import encode_words, id_and_text, read_table, rebatch
from lathe.llm.tokens import END_OF_WORD, assemble, default_vocabulary, lower_ascii, parts_of_units

#: White space as the vocabulary's normaliser knows it (Unicode White_Space).
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
START, NONE = -1, -2
#: Entries of the compatibility memo before it is emptied.
MEMO = 2_000_000
_END, _GAP = "\x00", "\x01"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {byte: chr(byte if byte in visible else next(spare)) for byte in range(256)}


class PrefixBpe:
    """A vocabulary with end-of-word marks: exact ids of texts, and texts of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.tokens = {number: token for token, number in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {number: token for token, number in self.special.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.split: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair = vocab[left], vocab[right]
            self.merged.setdefault(pair, rank)
            whole = vocab[left + right]
            if self.rank[whole] < 0:
                self.rank[whole] = rank
                self.split[whole] = pair
        self._memo: dict[int, bool] = {}
        self._alphabet = byte_alphabet()
        self._pieces = regex.compile(
            "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^" + SPACE + "\\p{L}\\p{N}]+"
        )
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for token, number in vocab.items():
            if self._reachable(number):
                key = token[: -len(END_OF_WORD)] + _END if token.endswith(END_OF_WORD) else token
                self.automaton.add_word(key, (number, len(key)))
        self.automaton.make_automaton()
        self.length = {n: len(t) - (len(END_OF_WORD) - 1) * t.endswith(END_OF_WORD) for n, t in self.tokens.items()}

    def _unmerged(self, left: int, right: int, limit: int) -> bool:
        """True if BPE applies no merge across the border of ``left`` and ``right`` before merge number ``limit``."""
        rank, split, merged = self.rank, self.split, self.merged
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            # Go back before the later of the two merges that made these tokens; of equal ones the right came later.
            if rank[left] > rank[right]:
                limit = min(limit, rank[left])
                left = split[left][1]
            else:
                limit = min(limit, rank[right] + 1)  # an equal merge across would have been further left, so first
                right = split[right][0]

    def _reachable(self, token: int) -> bool:
        if self.rank[token] < 0:
            text = self.tokens[token]
            return len(text) == 1 or (text.endswith(END_OF_WORD) and len(text) == 1 + len(END_OF_WORD))
        left, right = self.split[token]
        return self._reachable(left) and self._reachable(right) and self._unmerged(left, right, self.rank[token])

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            known = self._memo[key] = self._unmerged(left, right, len(self.merged) + 1)
        return known

    def pretokens(self, unit: str) -> list[str]:
        """The normalised pre-tokens of a unit that holds no special token."""
        text = regex.sub("[" + SPACE + "]+", " ", unicodedata.normalize("NFC", unit))
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self._pieces.findall(text)

    def encode_pretokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token: (lengths, ids one after another)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        to = self._alphabet
        shown = [w if w.isascii() and w.isprintable() else "".join(map(to.__getitem__, w.encode("utf-8"))) for w in words]
        text = (_END + _GAP).join(shown) + _END
        last = [NONE] * (len(text) + 1)
        at, starts = 0, []
        for word in shown:
            last[at] = START
            starts.append(at)
            at += len(word) + 2
        compatible, memo = self.compatible, self._memo
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] == NONE:
                before = last[end + 1 - length]
                if before == START:
                    last[end + 1] = token
                elif before >= 0:
                    known = memo.get(before << 32 | token)
                    if known or known is None and compatible(before, token):
                        last[end + 1] = token
        ids: list[int] = []
        lengths = np.zeros(len(words), dtype=np.int64)
        size = self.length
        for k in range(len(words) - 1, -1, -1):
            at, start, n = starts[k] + len(shown[k]) + 1, starts[k], 0
            while at > start:
                token = last[at]
                if token < 0:
                    raise ValueError(f"no encoding for {words[k]!r}: the vocabulary lacks a byte")
                ids.append(token)
                at -= size[token]
                n += 1
            lengths[k] = n
        return lengths, np.asarray(ids[::-1], dtype=np.uint32)

    def encode_units(self, units: list[str]):
        """Parts of each unit, index of the parts, and their ids."""
        parts, odd = parts_of_units(units)
        if odd:
            place = set(odd)
            made = {}
            for unit in odd:
                pieces = []
                for k, piece in enumerate(self._special.split(unit) if self._special else [unit]):
                    pieces.append([piece] if k % 2 else self.pretokens(piece))
                made[unit] = pieces
        else:
            place, made = set(), {}
        words = dict.fromkeys(p for unit in parts for p in unit if p not in place)
        for pieces in made.values():
            for k, piece in enumerate(pieces):
                if k % 2 == 0:
                    words.update(dict.fromkeys(piece))
        words = list(words)
        lengths, ids = self.encode_pretokens(words)
        starts = np.cumsum(lengths) - lengths
        where = {word: k for k, word in enumerate(words)}
        index = {word: k for word, k in where.items() if word not in place}
        extra: list[int] = []
        more = []
        for unit, pieces in made.items():
            own: list[int] = []
            for k, piece in enumerate(pieces):
                for word in piece:
                    own += [self.special[word]] if k % 2 else ids[starts[where[word]] :][: lengths[where[word]]].tolist()
            index[unit] = len(words) + len(more)
            more.append(len(own))
            extra += own
        lengths = np.concatenate([lengths, np.asarray(more, dtype=np.int64)])
        ids = np.concatenate([ids, np.asarray(extra, dtype=np.uint32)])
        return parts, index, np.cumsum(lengths) - lengths, lengths, ids

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every whole text: (offsets of length n + 1, ids)."""
        offsets, codes, units = encode_words(lower_ascii(texts))
        parts, index, starts, lengths, ids = self.encode_units(units)
        positions, per_unit = assemble(parts, index, starts, lengths, codes)
        before = np.concatenate(([0], np.cumsum(per_unit[codes] if len(codes) else np.zeros(0, np.int64))))
        return before[offsets], ids[positions]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[1].tolist()

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens, special ones included, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text of ``df``: doc_id, n_tokens, ids (little-endian, 32 bits each), decoded text.

    Null and empty texts have no ids and decode to the empty text; repeated rows stay; an empty table gives an empty
    one; other columns of ``df`` are left out, whatever their names.
    """
    path = path or default_vocabulary()

    def run(batches):
        bpe = load_bpe(path)
        tokens = np.empty(max(bpe.tokens) + 1, dtype=object)
        for number, token in bpe.tokens.items():
            tokens[number] = token
        for batch in rebatch(batches, "text"):
            offsets, ids = bpe.encode_texts(batch.column("text"))
            raw = ids.astype("<u4")
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([" ".join(tokens[ids[a:b]].tolist()) for a, b in spans], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op8_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    done = round_trip(read_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
