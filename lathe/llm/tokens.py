"""Token ids of whole texts with a public word-level BPE vocabulary, through the tokenizers library.

The vocabulary's normaliser and splitter never join text across ASCII white space, so a text's ids are the ids of its
white-space separated units, and each different unit is encoded once for as long as a worker's memo holds it.  Most units are letters followed by
ASCII punctuation; their two parts are single pre-tokens, which need no normalising and are encoded many to a call, each
ending in exactly one end-of-word token.  All other units go through the unchanged tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lathe.llm.batches import HELD, encode_words, ragged_take

#: Letters that normalising leaves alone, then ASCII punctuation without the apostrophe (it opens contractions).
PLAIN_UNIT = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")
END_OF_WORD = "</w>"
BLOCK = 512
#: Units, and characters and bytes of ids, that a worker's memo may hold before it is emptied.
MEMO_UNITS, MEMO_BYTES = 1 << 19, 64 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer as the library loads it, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _piecewise(path: str):
    """The same model over pre-tokens that are already normalised, separated by spaces; and which ids end a word."""
    load_tokenizer(path)
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    spec["normalizer"] = None
    split = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [split, level]}
    spec["added_tokens"] = []
    vocab = spec["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for token, number in vocab.items():
        ends[number] = token.endswith(END_OF_WORD)
    return Tokenizer.from_str(json.dumps(spec)), ends


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lowered, which leaves the ids as they are, but for texts that might hold (or come to hold) a special token."""
    texts = pc.fill_null(texts, "")
    special = pc.match_substring(texts, "<|")
    lowered = pc.ascii_lower(texts)
    return pc.if_else(special, texts, lowered) if pc.any(special).as_py() else lowered


def parts_of_units(units: list[str]) -> tuple[list[tuple[str, ...]], list[str]]:
    """For each unit its parts, pre-tokens if the unit is plain or else itself; and the units that are not plain."""
    parts, odd = [], []
    match = PLAIN_UNIT.fullmatch
    for unit in units:
        if found := match(unit):
            head, tail = found.groups()
            parts.append((head, tail) if head and tail else (unit,))
        else:
            parts.append((unit,))
            odd.append(unit)
    return parts, odd


def assemble(
    parts: list[tuple[str, ...]], index: dict[str, int], starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray
) -> np.ndarray:
    """Positions (in the parts' ids) of all ids of the units ``codes``; and ids per unit."""
    first = np.fromiter((index[p[0]] for p in parts), dtype=np.int64, count=len(parts))
    second = np.fromiter((index[p[1]] if len(p) > 1 else -1 for p in parts), dtype=np.int64, count=len(parts))
    pairs = np.stack([first[codes], second[codes]], axis=1).ravel()
    keep = pairs >= 0
    return ragged_take(starts, lengths, pairs[keep])[0], (
        lengths[first] + np.where(second >= 0, lengths[np.maximum(second, 0)], 0) if len(parts) else np.zeros(0, np.int64)
    )


def encode_parts(plain: list[str], odd: list[str], path: str) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Ids of pre-tokens and of other units: index of each part, starts, lengths, ids."""
    ids: list[int] = []
    lengths = np.zeros(0, dtype=np.int64)
    if plain:
        tokenizer, ends = _piecewise(path)
        blocks = [" ".join(plain[i : i + BLOCK]) for i in range(0, len(plain), BLOCK)]
        for encoded in tokenizer.encode_batch_fast(blocks, add_special_tokens=False):
            ids += encoded.ids
        stops = np.flatnonzero(ends[np.asarray(ids, dtype=np.int64)]) + 1
        if len(stops) != len(plain):
            raise ValueError("a pre-token has not exactly one end-of-word token in this vocabulary")
        lengths = np.diff(stops, prepend=0)
    if odd:
        more = [e.ids for e in load_tokenizer(path).encode_batch_fast(odd, add_special_tokens=False)]
        lengths = np.concatenate([lengths, np.fromiter(map(len, more), dtype=np.int64, count=len(more))])
        for x in more:
            ids += x
    index = {part: k for k, part in enumerate(plain)}
    index.update((unit, len(plain) + k) for k, unit in enumerate(odd))
    return index, np.cumsum(lengths) - lengths, lengths, np.asarray(ids, dtype=np.uint32)


class UnitMemo:
    """Ids of units already encoded by this worker, kept from batch to batch.

    Beyond ``MEMO_UNITS`` units or ``MEMO_BYTES`` of them it is emptied before the next batch, so its memory is bounded by
    these and one batch's units.
    """

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.size = 0

    def places(self, units: list[str]) -> np.ndarray:
        """The number of each of the different ``units``; those not yet known are encoded."""
        if len(self.index) > MEMO_UNITS or self.size > MEMO_BYTES:
            self.clear()
        found = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, count=len(units))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = np.arange(len(self.index), len(self.index) + len(missing))
            self._add([units[k] for k in missing.tolist()])
        return found

    def _add(self, units: list[str]) -> None:
        parts, odd = parts_of_units(units)
        strange = set(odd)
        plain = list(dict.fromkeys(p for unit in parts for p in unit if p not in strange))
        index, starts, lengths, ids = encode_parts(plain, odd, self.path)
        positions, per_unit = assemble(parts, index, starts, lengths, np.arange(len(units)))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(per_unit) - per_unit])
        self.lengths = np.concatenate([self.lengths, per_unit])
        self.ids = np.concatenate([self.ids, ids[positions]])
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units))))
        self.size += sum(map(len, units)) + 4 * len(positions)


@lru_cache(maxsize=1)
def _memo(path: str) -> UnitMemo:
    return UnitMemo(path)


def let_go() -> None:
    """Forget units and tokenizers; they are made anew when they are needed."""
    for made in (_memo, _piecewise, load_tokenizer):
        made.cache_clear()


HELD["units"] = let_go


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every whole text, special tokens not added: (offsets of length n + 1, ids as uint32)."""
    offsets, codes, units = encode_words(lower_ascii(texts))
    memo = _memo(path)
    which = memo.places(units)[codes]
    positions, ends = ragged_take(memo.starts, memo.lengths, which)
    return ends[offsets], memo.ids[positions]
