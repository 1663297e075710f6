"""Personal data in texts: exact base patterns, and a character-level bidirectional LSTM with a CRF that adds spans.

The network is trained in numpy on labelled spans: a seeded generator writes e-mail addresses, IP addresses, card and
telephone numbers in many spellings into prose of made-up words, among look-alikes (dates, prices, digests, versions,
identifiers) that are labelled as nothing.  It thus needs no pass over the corpus, and is the same for every input.

All of every text is decoded, in overlapping windows.  A text's position has its emissions from the window where it is
most central; they are joined to those of the whole text, over which the CRF is decoded once, so a span may be of any
length and lie anywhere.  Where bounds show that the best path
over the whole text has no span (``SpanNet.runs``), or no part of a run can be plausible (``bearing``), the CRF's search is
left out.  Addresses with the at sign spelled out
are also found by a pattern.  Base spans always stay, then those of the pattern; spans of the network that touch one are
dropped.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import id_and_text, read_table, rebatch, tune
from lathe.llm.nets import F32, Adam, best_tags, crf_gradient, glorot, lstm_backward, lstm_forward, lstm_scores, stacked, viterbi
from lathe.llm.secrets import span_digest

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile("[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: It starts with a set, as the engine skips to characters of it; a run's further digits are no start.
IP = re.compile("([0-9](?<![0-9]{2})[0-9]*)\\.([0-9]+)\\.([0-9]+)\\.([0-9]+)")
CARD = re.compile("[0-9](?:[\\x20-]?[0-9])+")
PHONE = re.compile("\\+[0-9][\\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
#: Marks of an address without an at sign: words of their own.
BRACKETED_AT = re.compile("[\\[({<]\\x20?at\\x20?[\\])}>]\\x20?", re.IGNORECASE)
PLAIN_AT = re.compile("\\x20at\\x20", re.IGNORECASE)
_DOT = "(?:\\x20?[\\[({<]\\x20?dot\\x20?[\\])}>]\\x20?|\\x20dot\\x20)"
_LABEL = "[A-Za-z0-9-]+"
SPELLED_HOST = re.compile(f"{_LABEL}(?:(?:\\.|{_DOT}){_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])", re.IGNORECASE)
DOTTED_HOST = re.compile(f"{_LABEL}(?:\\.{_LABEL})+")
DOT_BEFORE = re.compile(f"[A-Za-z0-9._%+-]{_DOT}$", re.IGNORECASE)
SPELLED_AT = re.compile("(?<![^\\W_])at(?![^\\W_])", re.IGNORECASE)
SPELLED_DOT = re.compile("\\.|(?<![^\\W_])dot(?![^\\W_])", re.IGNORECASE)

#: Characters of a training window.
SAMPLE = 64
#: Windows take STRIDE positions of a text each, and HALO further ones at either side, which are more central in their
#: neighbours.
STRIDE, HALO = 224, 16
#: Windows decoded together, about; OpenBLAS multiplies up to 625 (a million products) without rearranging its operands.
BATCH = 560
#: Batches that are made of texts together: several, so that they come to nearly BATCH windows each.
GROUP = 2
#: Positions that are searched for runs together, about: their sums should stay in a core's cache.
PIECE = 1 << 15
SYMBOLS = 132
#: A span's least mean margin (natural log of odds against the best other tag) to be taken from the network.
LEAST_MARGIN = 4.0


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits[-3:]) <= 255 if digits.strip("0") else True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that pass its test: (start, end, kind) by start, then kind.

    Each pattern is anchored where a match must begin (before an at sign, at a run of digits, at a plus), so the time is
    linear in the text.
    """
    spans: list[tuple[int, int, str]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end(), "email"))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    digit = DIGITS.search(text)
    if not digit:
        return spans
    for found in IP.finditer(text, digit.start()):
        if all(map(_part, found.groups())):
            spans.append((*found.span(), "ip"))
    for found in CARD.finditer(text, digit.start()):
        digits = found[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((*found.span(), "card"))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(found[0])) <= 15:
                spans.append((*found.span(), "phone"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def spelled_spans(text: str) -> list[tuple[int, int, str]]:
    """Addresses whose at sign is spelled out: ``x [at] y.z``, ``x (at) y (dot) z``, ``x at y dot z``; without overlaps.

    A plain "at" needs a spelled dot, as prose may stand before a host's name.
    """
    spans: list[tuple[int, int, str]] = []
    done = 0
    marks = [(m.start(), m.end(), False) for m in PLAIN_AT.finditer(text)]
    marks += [(m.start(), m.end(), True) for m in BRACKETED_AT.finditer(text)]
    for left, right, bracketed in sorted(marks):
        host = SPELLED_HOST.match(text, right) or (DOTTED_HOST.match(text, right) if bracketed else None)
        if not host or left < done:
            continue
        end = left - (bracketed and left > done and text[left - 1] == " ")
        start = _local_start(text, end, done)
        # Further parts of the name before a spelled dot.
        while start < end and (dot := DOT_BEFORE.search(text[max(done, start - 12) : start])):
            before = start - len(dot[0]) + 1
            start = _local_start(text, before, done)
        if start < end:
            spans.append((start, host.end(), "email"))
            done = host.end()
    return spans


def _local_start(text: str, end: int, least: int) -> int:
    """Where the run of name characters before ``end`` begins."""
    start = end
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    return start


def _name_start(text: str, start: int, end: int) -> int:
    """Where an address that the network found begins: at the run of name characters before its at sign."""
    at = text.find("@", start, end)
    while at > start and text[at - 1] in " ([{<":
        at -= 1
    name = _local_start(text, at, start)
    return name if start <= name < at else start


@dataclass(frozen=True)
class Training:
    """Bounds of the training: labelled windows, steps, windows in a step, and sizes of the network."""

    windows: int = 1600
    steps: int = 600
    batch: int = 64
    embed: int = 8
    hidden: int = 16
    rate: float = 0.012
    seed: int = 11


def symbols(codes: np.ndarray) -> np.ndarray:
    """Code points as network inputs: ASCII as it is, then Latin letters, other characters; 0 is the padding."""
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, np.where(codes == 0xFFFFFFFF, 131, 129))).astype(
        np.uint8
    )


def _word(rng: random.Random) -> str:
    if rng.random() < 0.3:
        syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü ñ ón sch"
        return "".join(rng.choices(syllables.split(), k=rng.randint(1, 4)))
    # Words of any language: syllables of a few consonants around vowels.
    ahead = "b c ch d f g gr h j k l ll m n p pr qu r s sh sp st t th tr v w y z ß ñ ç".split() + [""] * 4
    heart = "a e i o u a e i o u ai au ea ei io ou ie ä é ê ó ö ü".split()
    behind = "n ng r s t l m nd nt ck ch rt st x".split() + [""] * 14
    return "".join(rng.choice(ahead) + rng.choice(heart) + rng.choice(behind) for _ in range(rng.randint(1, 5)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits(rng, 14)
    body += next(d for d in "0123456789" if luhn(body + d))
    sep = rng.choice(["", "", " ", "-", ".", " - "])
    return sep.join(body[i : i + 4] for i in range(0, 16, 4))


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    country = rng.choice(["1", "44", "49", "33", "34", "7"])
    return rng.choice(
        [f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country} ({a}) {b}-{c}", f"({a}) {b}-{c}"]
        + [f"{a}-{b}-{c}", f"00{country} {a} {b} {c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"+{country}{a}{b}{c}"]
    )


def _ip(rng: random.Random) -> str:
    parts = [str(rng.randint(0, 255)) for _ in range(4)]
    return rng.choice([".".join(parts)] * 3 + ["[.]".join(parts), " . ".join(parts), "-".join(parts)])


def _email(rng: random.Random) -> str:
    if rng.random() < 0.1:
        return _spelled(rng)
    name = re.sub("[^a-z]", "", _word(rng)) or "ab"
    host, end = re.sub("[^a-z]", "", _word(rng)) or "mail", rng.choice(["com", "org", "net", "de", "example.com"])
    name += rng.choice(["", "", f".{_digits(rng, 2)}", _digits(rng, 2), "_x"])
    return rng.choice(
        [f"{name}@{host}.{end}"] * 3 + [f"{name}@{host}{_digits(rng, 1)}.{end}", f"{name} @ {host}.{end}"]
        + [f"{name}(@){host}.{end}", f"{name}[at]{host}{_digits(rng, 1)}[dot]{end}"]
    )


def _spelled(rng: random.Random) -> str:
    """An address without digits or an at sign, its marks spelled out."""
    plain = lambda: re.sub("[^a-z]", "", _word(rng)) or "ab"
    at, dot = rng.choice([(" at ", " dot ")] * 3 + [(" [at] ", " [dot] ")] * 2 + [("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)")])
    name = plain() + rng.choice(["", "", f".{plain()}", f"_{plain()}"])
    host = dot.join(plain() for _ in range(rng.choice([1, 1, 1, 2])))
    return f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'edu'])}"


def _other(rng: random.Random) -> str:
    """Look-alikes that are no personal data."""
    d = lambda n: _digits(rng, n)
    return rng.choice(
        [f"19{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}:{d(2)}", f"{d(2)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", d(1), d(2)]
        + ["".join(rng.choices("0123456789abcdef", k=rng.choice([8, 24, 32, 40]))), f"v{d(1)}.{d(2)}.{d(1)}", f"#{d(5)}"]
        + [f'token = "{"".join(rng.choices("0123456789abcdef", k=32))}"', f"{d(3)}%", f"@{_word(rng)}", f"${d(4)}", d(6)]
        + [f"{d(2)}/{d(2)}/20{d(2)}", f"ISBN 978-{d(1)}-{d(4)}", f"[{d(2)}]", f"{_word(rng)}{d(2)}", f"{d(3)}-{d(2)}"]
        + [f"{_word(rng)} at {_word(rng)}", f"at {_word(rng)}.", f"{_word(rng)} dot {_word(rng)}", f"{_word(rng)}at{_word(rng)}"]
        + [d(20), f"{d(2)} {d(2)} {d(2)}", f"AKIA{''.join(rng.choices('ABCDEFGH0123456789', k=16))}", f"{d(7)}"]
    )


def labelled_windows(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated windows: inputs and tags, both (count, SAMPLE).  Tag 0 is none, then first and further of each kind."""
    rng = random.Random(seed)
    makers = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}
    inputs, tags = np.zeros((count, SAMPLE), np.int64), np.zeros((count, SAMPLE), np.int64)
    for row in range(count):
        text, tag = "", []
        while len(text) < 2 * SAMPLE:
            choice = rng.random()
            if choice < 0.16:
                kind = rng.choice(KINDS)
                piece = makers[kind](rng)
                k = 1 + 2 * KINDS.index(kind)
                own = [k] + [k + 1] * (len(piece) - 1)
            else:
                piece = _other(rng) if choice < 0.36 else _word(rng)
                case = rng.random()
                piece = piece.upper() if case < 0.1 else piece.capitalize() if case < 0.25 else piece
                own = [0] * len(piece)
            mark = rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", "*** ", "!! ", " | ", "&&& ", '" ', "; ", ": ", "### "])
            text += piece + mark
            tag += own + [0] * len(mark)
        start = rng.randint(0, SAMPLE)
        codes = np.frombuffer(text[start : start + SAMPLE].encode("utf-32-le"), "<u4")
        inputs[row, : len(codes)] = symbols(codes)
        tags[row, : len(codes)] = tag[start : start + SAMPLE][: len(codes)]
        if rng.random() < 0.15:
            cut = rng.randint(SAMPLE // 3, SAMPLE)
            inputs[row, cut:], tags[row, cut:] = 0, 0
    return inputs, tags


class SpanNet:
    """Embeddings, a bidirectional LSTM, and a CRF over nine tags."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, training: Training = Training()):
        rng = np.random.default_rng(training.seed)
        e, h = training.embed, training.hidden
        self.p = {
            "embed": (rng.standard_normal((SYMBOLS, e)) * 0.3).astype(F32),
            "wf": glorot(rng, e, 4 * h),
            "uf": glorot(rng, h, 4 * h),
            "bf": np.zeros(4 * h, F32),
            "wb": glorot(rng, e, 4 * h),
            "ub": glorot(rng, h, 4 * h),
            "bb": np.zeros(4 * h, F32),
            "out": glorot(rng, 2 * h, self.TAGS),
            "bias": np.zeros(self.TAGS, F32),
            "trans": np.zeros((self.TAGS, self.TAGS), F32),
        }
        self.p["bf"][h : 2 * h] = self.p["bb"][h : 2 * h] = 1
        #: A further tag follows only its kind's first or further tag.
        self.barred = np.zeros((self.TAGS, self.TAGS), F32)
        for k in range(2, self.TAGS, 2):
            self.barred[:, k] = -1e4
            self.barred[[k - 1, k], k] = 0
        self._fit(training)
        self._tables()

    def _fit(self, training: Training) -> None:
        inputs, tags = labelled_windows(training.windows, training.seed)
        rng = np.random.default_rng(training.seed)
        adam = Adam(self.p, training.rate)
        p = self.p
        for step in range(training.steps):
            adam.rate = training.rate * min(1, 2 * (1 - step / training.steps))
            rows = rng.integers(0, len(inputs), training.batch)
            x, y = inputs[rows].T, tags[rows].T
            steps, batch = x.shape
            vec = p["embed"][x]
            ahead, kept_f = lstm_forward(vec @ p["wf"] + p["bf"], p["uf"], True)
            behind, kept_b = lstm_forward((vec @ p["wb"] + p["bb"])[::-1], p["ub"], True)
            both = np.concatenate([ahead, behind[::-1]], axis=2)
            emit = both @ p["out"] + p["bias"]
            _, d_emit, d_trans = crf_gradient(emit, p["trans"] + self.barred, y)
            flat = d_emit.reshape(-1, self.TAGS)
            d_both = d_emit @ p["out"].T
            h = ahead.shape[2]
            dzf, duf = lstm_backward(d_both[:, :, :h], p["uf"], kept_f)
            dzb, dub = lstm_backward(d_both[::-1, :, h:], p["ub"], kept_b)
            dzb = dzb[::-1]
            d_vec = (dzf @ p["wf"].T + dzb @ p["wb"].T).reshape(steps * batch, -1)
            d_embed = np.zeros_like(p["embed"])
            np.add.at(d_embed, x.ravel(), d_vec)
            cols = vec.reshape(steps * batch, -1).T
            adam.update(
                {
                    "embed": d_embed,
                    "wf": cols @ dzf.reshape(steps * batch, -1),
                    "uf": duf,
                    "bf": dzf.sum((0, 1)),
                    "wb": cols @ dzb.reshape(steps * batch, -1),
                    "ub": dub,
                    "bb": dzb.sum((0, 1)),
                    "out": both.reshape(steps * batch, -1).T @ flat,
                    "bias": flat.sum(0),
                    "trans": d_trans.astype(F32),
                }
            )

    def _tables(self) -> None:
        """Weights as decoding takes them."""
        p, h = self.p, self.p["uf"].shape[0]
        self.ahead = stacked(p["wf"], p["uf"], p["bf"]), np.ascontiguousarray(p["out"][:h])
        self.behind = stacked(p["wb"], p["ub"], p["bb"]), np.ascontiguousarray(p["out"][h:])

    def emissions(self, texts: list[np.ndarray]) -> np.ndarray:
        """Emissions (positions, TAGS) of whole texts one after another, given as symbols.

        Each position has them from the window where it is most central.  A tag's column is contiguous.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts)
        base = np.cumsum(sizes) - sizes
        counts = -(-sizes // STRIDE)
        owner = np.repeat(np.arange(len(texts)), counts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        last = np.minimum(first + STRIDE, sizes[owner])
        start, stop = np.maximum(first - HALO, 0), np.minimum(last + HALO, sizes[owner])
        emit = np.empty((self.TAGS, len(flat)), F32)
        embed = np.ascontiguousarray(self.p["embed"].T)
        order = np.argsort(start - stop, kind="stable")
        # Batches of one size, as a small last one would take as many steps as a full one.
        size = -(-len(order) // max(1, round(len(order) / BATCH)))
        for k in range(0, len(order), size):
            part = order[k : k + size]
            length, at, skip, own = (stop - start)[part], (base[owner] + start)[part], (first - start)[part], (last - first)[part]
            steps = int(length[0])
            active = np.searchsorted(-length, -np.arange(steps), side="left").tolist()
            x = np.zeros((len(part), steps), np.uint8)
            windows = list(zip(at.tolist(), length.tolist(), skip.tolist(), own.tolist()))
            for row, (a, n, _, _) in enumerate(windows):
                x[row, :n] = flat[a : a + n]
            inputs = embed.take(np.ascontiguousarray(x.T), axis=1, mode="clip")
            scores = np.zeros((steps, self.TAGS, len(part)), F32)
            lstm_scores(inputs, active, *self.ahead, scores)
            lstm_scores(inputs, active, *self.behind, scores, back=True)
            scores = np.ascontiguousarray(scores.transpose(1, 2, 0))
            for row, (a, _, s, w) in enumerate(windows):
                emit[:, a + s : a + s + w] = scores[:, row, s : s + w]
        emit += self.p["bias"][:, None]
        return emit.T

    def runs(self, emit: np.ndarray, begins: np.ndarray | None = None, least: float = 0.0) -> list[tuple[int, int]]:
        """Parts of texts outside which the best path has no spans: (start, end).

        ``emit`` has the emissions of texts one after another, which begin at ``begins`` (None: one text).  A span is on
        the best path only if it gains over none at its positions.  Its emissions and inner transitions are added up from
        sums over the text, and the transitions into and out of it taken at their best.  A span gains at least its least
        margin, so parts without one that may gain ``least`` are left out as well.
        """
        trans = self.p["trans"].astype(np.float64)
        own = np.arange(1, self.TAGS, 2)
        into = (trans[:, own] - trans[:, :1]).max(axis=0)
        onward = np.concatenate(([0], own))
        leave = np.maximum(trans[own][:, onward], trans[own + 1][:, onward]) - trans[0, onward]
        step = trans[own, own + 1] - trans[own + 1, own + 1]
        none = emit[:, 0]
        bound = (into + leave.max(axis=1) + np.maximum(step, 0) + 0.001).astype(F32)
        inner = trans[own + 1, own + 1] - trans[0, 0]
        some = np.zeros(len(emit), bool)
        kinds = []
        for k, tag in enumerate(own.tolist()):
            first = emit[:, tag] - none
            first += bound[k]
            further = (emit[:, tag + 1] - none).astype(np.float64)
            further += inner[k]
            if begins is not None:
                further[begins] = -1e6  # No span goes on into the next text.
            if max(first.max(initial=-1), further.max(initial=-1)) <= 0:
                continue  # Nothing is gained anywhere.
            np.cumsum(further, out=further)
            most = np.maximum.accumulate(further[::-1])[::-1]
            gain = most - further
            gain += first
            some |= gain > 0
            kinds.append((first, further, most, gain))
        starts = np.flatnonzero(some)
        if not len(starts):
            return []
        stops, gains = starts + 1, np.full(len(starts), -np.inf)
        for first, further, most, gain in kinds:
            np.maximum(gains, gain[starts], out=gains)
            which = np.flatnonzero(gain[starts] > 0)
            low = further[starts[which]] - first[starts[which]]
            # ``most`` falls, so the last position above ``low`` is found by bisection.
            ends = len(emit) - np.searchsorted(most[::-1], low, side="right")
            stops[which] = np.maximum(stops[which], ends)
        if begins is not None:
            ends = np.append(begins[1:], len(emit))
            stops = np.minimum(stops, ends[np.searchsorted(begins, starts, side="right") - 1])
        reach = np.maximum.accumulate(stops)
        new = starts[1:] > reach[:-1] + 1
        if begins is not None:
            new |= np.diff(np.searchsorted(begins, starts, side="right")) > 0
        breaks = np.flatnonzero(new) + 1
        heads = np.concatenate(([0], breaks))
        enough = np.maximum.reduceat(gains, heads) >= least
        end = reach[np.concatenate((breaks, [len(starts)])) - 1] + 1
        limit = len(emit)
        if begins is not None:
            limit = np.append(begins[1:], limit)[np.searchsorted(begins, starts[heads], side="right") - 1]
        end = np.minimum(end, limit)
        return list(zip(starts[heads][enough].tolist(), end[enough].tolist()))

    def best(self, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tags and margins of runs of emissions, each with none before and after it."""
        found: list = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        trans = self.p["trans"] + self.barred
        at = 0
        while at < len(order):
            # Runs of about one length together, in bounded memory.
            length = max(16, len(runs[order[at]]) * 5 // 4)
            stop = at + 1
            while stop < len(order) and len(runs[order[stop]]) <= length and (stop - at) * length < 1 << 16:
                stop += 1
            length = len(runs[order[stop - 1]]) + 1
            emit = np.full((length, self.TAGS, stop - at), -1e4, F32)
            emit[:, 0] = 0
            for col, k in enumerate(order[at:stop]):
                emit[: len(runs[k]), :, col] = runs[k]
            emit[0] += trans[0][:, None]
            tags, margin = best_tags(emit, trans)
            for col, k in enumerate(order[at:stop]):
                found[k] = tags[: len(runs[k]), col], margin[: len(runs[k]), col]
            at = stop
        return found


@lru_cache(maxsize=2)
def trained(training: Training = Training()) -> SpanNet:
    return SpanNet(training)


def inputs_of(text: str) -> np.ndarray:
    """A text's code points as network inputs."""
    return symbols(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"))


def spans_in(tags: np.ndarray, margins: np.ndarray, at: int) -> list[tuple[int, int, str, float]]:
    """Spans of a decoded run that begins at ``at``: (start, end, kind, mean margin)."""
    found: list[tuple[int, int, str, float]] = []
    if not tags.any():
        return found
    for start in np.flatnonzero(tags % 2 == 1).tolist():
        kind, end = int(tags[start]), start + 1
        while end < len(tags) and tags[end] == kind + 1:
            end += 1
        found.append((at + start, at + end, KINDS[kind // 2], float(margins[start:end].mean())))
    return found


def plausible(text: str, kind: str) -> bool:
    """What a kind's span must hold, so that a stray tag is no finding."""
    digits = len(DIGITS.findall(text))
    if kind == "email":
        marked = "@" in text or (SPELLED_AT.search(text) and SPELLED_DOT.search(text))
        return len(text) >= 6 and bool(marked) and text[-1].isalnum() and text[0].isalnum()
    if kind == "ip":
        return 4 <= digits <= 12 and len(re.findall("[0-9]+", text)) == 4
    if kind == "card":
        number = "".join(DIGITS.findall(text))
        return 12 <= digits <= 19 and luhn(number)
    return 9 <= digits <= 15 and text[-1].isdigit() and len(text) <= 2 * digits


def bearing(text: str) -> bool:
    """Whether a part of the text can be plausible as any kind; a part's edges may set an "at" or "dot" free."""
    low = text.lower()
    if "@" in text or ("at" in low and ("." in text or "dot" in low)):
        return True
    return len(DIGITS.findall(text)) >= 4


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of the texts that are not empty, in groups of about GROUP batches."""
    group, held = [], 0
    for k, text in enumerate(texts):
        if text:
            group.append(k)
            held += -(-len(text) // STRIDE)
            if held >= GROUP * BATCH:
                yield group
                group, held = [], 0
    if group:
        yield group


def _pieces(begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that begin within PIECE positions of the range's first."""
    first = 0
    while first < len(begins):
        last = int(np.searchsorted(begins, begins[first] + PIECE))
        yield first, last
        first = last


def add_network(
    texts: list[str], base: list[list[tuple[int, int, str]]], net: SpanNet, least: float = LEAST_MARGIN
) -> list[list[tuple[int, int, str]]]:
    """Base spans, spelled-out addresses and the network's spans clear of these, in order."""
    spans = []
    for text, own in zip(texts, base):
        spelled = spelled_spans(text)
        spans.append(own + [x for x in spelled if all(x[1] <= s or x[0] >= e for s, e, _ in own)])
    fixed = [list(own) for own in spans]
    runs: list[np.ndarray] = []
    places: list[tuple[int, int]] = []

    for group in _groups(texts):
        emit = net.emissions([inputs_of(texts[k]) for k in group])
        begins = np.cumsum([0, *(len(texts[k]) for k in group[:-1])])
        for first, last in _pieces(begins):
            head, tail = int(begins[first]), int(begins[last]) if last < len(begins) else len(emit)
            for start, end in net.runs(emit[head:tail], begins[first:last] - head, least):
                own = int(np.searchsorted(begins, head + start, side="right")) - 1
                k, at = group[own], head + start - int(begins[own])
                # Of what others hold nothing would be kept below.
                if bearing(texts[k][at : at + end - start]):
                    runs.append(emit[head + start : head + end].copy())
                    places.append((k, at))
    for (k, at), (tags, margins) in zip(places, net.best(runs)):
        for a, b, kind, margin in spans_in(tags, margins, at):
            a = _name_start(texts[k], a, b) if kind == "email" else a
            clear = all(b <= s or a >= e for s, e, _ in fixed[k])
            if clear and margin >= least and plausible(texts[k][a:b], kind):
                spans[k].append((a, b, kind))
    for own in spans:
        own.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def all_spans(texts: pa.Array, net: SpanNet) -> list[list[tuple[int, int, str]]]:
    """Spans of every text of an array without nulls."""
    own = texts.to_pylist()
    return add_network(own, [base_spans(t) for t in own], net)


def find_personal(
    df: DataFrame, training: Training = Training(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Personal data of every whole text of ``df``: doc_id, spans (array of start, end, kind, in code points).

    Null and empty texts have none; repeated rows stay; an empty table gives an empty one; other columns of ``df`` are
    left out.
    """
    net = trained(training)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in rebatch(batches, "text"):
            spans = all_spans(batch.column("text"), net)
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in found] for found in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return id_and_text(df, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<start: bigint, end: bigint, kind: string>>"
    )


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (or run of overlapping ones) replaced by its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(
    df: DataFrame, training: Training = Training(), text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """``df`` with personal data taken out of its texts; a column of text lengths follows.

    Null and empty texts stay as they are, repeated rows all stay; an empty table gives an empty one.
    """
    net = trained(training)
    tune(df.sparkSession)
    length_col = length_col if length_col in df.columns else None

    def run(batches):
        for batch in rebatch(batches, text_col):
            texts = batch.column(text_col)
            full = pc.fill_null(texts, "")
            found = all_spans(full, net)
            hit = [k for k, spans in enumerate(found) if spans]
            if hit:
                new = texts.to_pylist()
                for k in hit:
                    new[k] = redacted(new[k], found[k])
                place = batch.schema.get_field_index(text_col)
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, texts.type))
                if length_col:
                    place = batch.schema.get_field_index(length_col)
                    old = batch.column(place)
                    lengths = pc.if_else(
                        pa.array(np.array([bool(s) for s in found])), pc.utf8_length(batch.column(text_col)).cast(old.type), old
                    )
                    batch = batch.set_column(place, batch.schema.field(place), lengths)
            yield batch

    return df.mapInArrow(run, df.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return span_digest(find_personal(read_table(spark, sf_dir, "documents")), KINDS)
