"""Secrets in texts: a keyword automaton first, anchored expressions near its hits, then embedded checksums.

One pass of an Aho-Corasick automaton over the lower-cased text finds every keyword; most texts have none and are done.
Each hit is tried with the expression of its kind, anchored at the keyword.  Long hexadecimal runs have no keyword: their
filter looks at every second byte of a whole batch for twelve hexadecimal digits in a row, which any run of 24 holds.
Tokens with a checksum (a base-62 CRC-32 of their body) count only if it agrees.
"""

from __future__ import annotations

import re
import string
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.batches import id_and_text, read_table, rebatch

#: Base kinds, in the order that breaks ties of spans with one start; then the kinds that the method adds.
KINDS = ("assign", "access", "hex", "github", "npm", "pem")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "api_key": "assign",
    "apikey": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "-----begin ": "pem",
}
ASSIGN = re.compile(
    "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
GITHUB = re.compile("gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile("npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PEM_BEGIN = re.compile("-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Lines ``Name: value``, which may be folded, ahead of a key's body.
PEM_HEADERS = re.compile("(?:\\s*[A-Za-z0-9-]+:[^\\n]*(?:\\n[ \\t][^\\n]*)*(?:\\n|$))+")
PEM_BODY = re.compile("[A-Za-z0-9+/=\\s]+")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
ADDED = {"github": GITHUB, "npm": NPM}


def checksum62(body: str) -> str:
    """CRC-32 in six base-62 digits."""
    number, digits = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits


def pem_end(text: str, start: int) -> int:
    """Where the private key that begins at ``start`` ends, or -1.

    Its end mark is the next five dashes, so the time is linear in the text however long the key.  Between the marks stand
    header lines, if any, and base64 in whole groups of four; line ends may be spelled as in a quoted string.
    """
    begin = PEM_BEGIN.match(text, start)
    if not begin:
        return -1
    mark = f"-----END {begin[1]}-----"
    stop = text.find("-----", begin.end())
    if stop < 0 or not text.startswith(mark, stop):
        return -1
    body = text[begin.end() : stop].replace("\\r", "\r").replace("\\n", "\n")
    if headers := PEM_HEADERS.match(body):
        body = body[headers.end() :]
    size = len("".join(body.split()))
    return stop + len(mark) if PEM_BODY.fullmatch(body) and size and size % 4 == 0 else -1


@lru_cache(maxsize=1)
def automaton():
    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def hex_suspects(texts: pa.Array) -> np.ndarray:
    """Texts that may hold 24 hexadecimal digits in a row: all that do, and hardly any other."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    suspects = np.zeros(len(texts), dtype=bool)
    if data is None or offsets[-1] - offsets[0] < 24:
        return suspects
    table = np.zeros(256, dtype=bool)
    table[list(b"0123456789abcdef")] = True
    run = table[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1] : 2]]
    two = run[:-1] & run[1:]
    four = two[:-2] & two[2:]
    eight = four[:-4] & four[4:]
    twelve = eight[:-4] & four[8:] if len(eight) > 4 else eight[:0]
    places = np.flatnonzero(twelve) * 2 + offsets[0]
    suspects[np.searchsorted(offsets, places, side="right") - 1] = True
    # A run may begin before a text's border on this grid, so the next text is a suspect as well.
    ends = np.searchsorted(offsets, places + 23, side="right") - 1
    suspects[np.minimum(ends, len(texts) - 1)] = True
    return suspects


def scan(text: str, lowered: str, hex_suspect: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, end exclusive, by start and kind."""
    spans: list[tuple[int, int, str]] = []
    last: dict[str, int] = {}
    for end, (length, kind) in automaton().iter(lowered):
        start = end + 1 - length
        if start < last.get(kind, 0):
            continue
        if kind == "assign":
            if found := ASSIGN.match(text, start):
                last[kind] = found.end()
                if len(found[2]) >= 6:
                    spans.append((start, found.end(), kind))
        elif kind == "access":
            if found := ACCESS.match(text, start):
                last[kind] = found.end()
                if found.end() - start >= 20:
                    spans.append((start, found.end(), kind))
        elif kind == "pem":
            if (stop := pem_end(text, start)) >= 0:
                last[kind] = stop
                spans.append((start, stop, kind))
        elif (found := ADDED[kind].match(text, start)) and checksum62(found[1]) == found[2]:
            last[kind] = found.end()
            spans.append((start, found.end(), kind))
    if hex_suspect:
        spans += [(*found.span(), "hex") for found in HEX.finditer(text)]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text of ``df``: doc_id, spans (array of start, end, kind, in code points).

    Null and empty texts have none; repeated rows stay; an empty table gives an empty one; other columns of ``df`` are
    left out.
    """

    def run(batches):
        for batch in rebatch(batches, "text"):
            texts = batch.column("text")
            suspects = hex_suspects(texts)
            lowered = pc.ascii_lower(texts).to_pylist()
            spans = [scan(t, low, s) for t, low, s in zip(texts.to_pylist(), lowered, suspects.tolist())]
            rows = [[{"start": a, "end": b, "kind": kind} for a, b, kind in found] for found in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return id_and_text(df, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<start: bigint, end: bigint, kind: string>>"
    )


def span_digest(found: DataFrame, base_kinds: tuple[str, ...]) -> DataFrame:
    """Counts of base kinds, the digest of base spans, and all spans as text; spans are in order."""
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *(_count(kind).alias(f"n_{kind}") for kind in base_kinds),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(*base_kinds))), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def _count(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return span_digest(find_secrets(read_table(spark, sf_dir, "documents")), BASE_KINDS)
