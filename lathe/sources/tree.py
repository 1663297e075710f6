"""Rows from documents: tag events of XML, relaxed JSON and log text, and the matcher that turns them into rows.

A document becomes a stream of events.  Each wanted path looks for elements whose ancestor chain ends with its parts
(``*`` stands for any number of levels, and each further one in a row for one more).  A row is complete when an element
of some path ends and all paths have a value; values of outer elements are thus carried down to repeated inner ones.  A
new match of a path clears all paths that first matched after it.  With a ``sync`` path, each end of its element gives a
row instead, and what did not match is empty.

One document is read by one task, front to back; documents are spread over the cluster.
"""

from __future__ import annotations

import csv
import html
import html.entities
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.plans.spec import SpecError

#: ("start", name, attributes, line), ("text", text), ("end", name), where texts have entities; ("leaf", name, text, line)
#: is an element without attributes or further elements, its text without entities.
Event = tuple

_ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")


def escaped(text: str) -> str:
    """Text with entities for what would be markup."""
    return html.escape(text, quote=False) if "&" in text or "<" in text or ">" in text else text


def decoded(text: str) -> str:
    """Text with entities as what they stand for; what has no semicolon, or no meaning, is text."""

    def one(found):
        if found[3]:
            return html.entities.html5.get(f"{found[3]};", found[0])
        code = int(found[1]) if found[1] else int(found[2], 16)
        return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else found[0]

    return _ENTITY.sub(one, text) if "&" in text else text


_TAG = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<![^>]*>|<(?P<close>/)?(?P<body>[^<>]*)>", re.S)
_OPEN = re.compile(r"""([^\s=/'"]+)((?:\s+[^\s=/]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/)?""", re.S)
_ATTR = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.S)


def xml_events(text: str) -> Iterator[Event]:
    """Events of XML text; several roots and fragments will do."""
    at, line, counted = 0, 1, 0
    for found in _TAG.finditer(text):
        if found.start() > at:
            yield "text", text[at : found.start()]
        line += text.count("\n", counted, found.start())
        counted = found.start()
        at = found.end()
        if found["cdata"] is not None:
            yield "text", escaped(found["cdata"])
        elif found["close"]:
            yield "end", found["body"].strip()
        elif found["body"] is not None:
            tag = _OPEN.fullmatch(found["body"].strip())
            if not tag:
                raise SpecError(f"Invalid XML tag: {found[0]}")
            attrs = {k: decoded(a or b or "") for k, a, b in _ATTR.findall(tag[2])}
            yield "start", tag[1], attrs, line
            if tag[3]:
                yield "end", tag[1]
    rest = text[at:]
    if "<" in rest:
        raise SpecError(f"Invalid XML tag: {rest[rest.index('<') :][:80]}")
    if rest:
        yield "text", rest


_JSON = re.compile(r"""\s*(?:([{}\[\],:])|"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'|([^\s{}\[\],:"']+))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _json_text(raw: str) -> str:
    def one(found):
        code = found[1]
        return chr(int(code[1:], 16)) if code[0] == "u" and len(code) == 5 else _ESCAPES.get(code[0], code)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, raw, flags=re.S)


def json_events(text: str, root: str = "json") -> Iterator[Event]:
    """Events of relaxed JSON: bare words, either quote, missing or extra commas, several values one after another.

    An object's property is an element; an array repeats its element; a top-level array's elements are ``row``, those of
    an array within an array are ``0``.  An object under ``_attr`` gives its owner's attributes.

    Tokens are read when they are needed and dropped when they are past; only an object that may have attributes is looked
    through before its own events.
    """
    tokens: list[tuple] = []
    at, line, counted, pos = 0, 1, 0, 0
    owned = "_attr" in text or "\\" in text

    def more() -> bool:
        """Reads some further tokens behind those held; false at the end of the text."""
        nonlocal at, line, counted
        before = len(tokens)
        while len(tokens) < before + 256:
            found = _JSON.match(text, at)
            if not found:
                if rest := text[at:].strip():
                    raise SpecError(f'Unexpected "{rest[:20]}" in JSON')
                break
            kind = found.lastindex
            start = found.start(kind) - (kind in (2, 3))
            line += text.count("\n", counted, start)
            counted, at = start, found.end()
            word = found[kind]
            if kind == 1:
                tokens.append((word, None, line))
            else:
                tokens.append(("word", _json_text(word) if kind != 4 and "\\" in word else word, line))
        return len(tokens) > before

    def here() -> bool:
        """Whether there is a token at ``pos``."""
        nonlocal pos
        if pos < len(tokens):
            return True
        tokens.clear()
        pos = 0
        return more()

    def attributes() -> dict[str, str]:
        """Attributes of the object that opens at ``pos``: its own ``_attr`` property."""
        nonlocal pos
        del tokens[:pos]
        j, depth, found, pos = 0, 0, {}, 0
        has = lambda k: k < len(tokens) or more()
        while has(j):
            kind, word, _ = tokens[j]
            depth += (kind in "{[") - (kind in "}]")
            if not depth:
                break
            if depth == 1 and word == "_attr" and has(j + 1) and has(j + 2) and tokens[j + 2][0] == "{":
                words, k = [], j + 3
                while has(k) and tokens[k][0] != "}":
                    if tokens[k][0] == "word":
                        words.append(tokens[k][1])
                    k += 1
                found = dict(zip(words[::2], words[1::2]))
            j += 1
        return found

    def value(name: str) -> Iterator[Event]:
        """Events of the value at ``pos`` as an element; ``pos`` is moved behind it."""
        nonlocal pos
        kind, word, where = tokens[pos]
        if kind == "[":
            pos += 1
            while here() and tokens[pos][0] != "]":
                kind, word, where = tokens[pos]
                if kind == ",":
                    pos += 1
                elif kind == "[":
                    yield "start", name, {}, where
                    yield from value("0")
                    yield "end", name
                else:
                    yield from value(name)
            pos += 1
        elif kind == "{":
            yield "start", name, attributes() if owned else {}, where
            pos += 1
            while here() and (kind := tokens[pos][0]) != "}":
                if kind in ",:":
                    pos += 1
                    continue
                key = tokens[pos][1] or ""
                pos += 1
                if here() and tokens[pos][0] == ":":
                    pos += 1
                if here():
                    kind, word, where = tokens[pos]
                    if key == "_attr" and kind == "{":
                        depth = 0
                        while here():
                            depth += (tokens[pos][0] == "{") - (tokens[pos][0] == "}")
                            pos += 1
                            if not depth:
                                break
                    elif kind in "{[":
                        yield from value(key)
                    else:
                        yield "leaf", key, word or "", where
                        pos += 1
            pos += 1
            yield "end", name
        else:
            yield "leaf", name, word or "", where
            pos += 1

    while here():
        if tokens[pos][0] in ",:]}":
            pos += 1
        else:
            yield from value("row" if tokens[pos][0] == "[" else root)


_DATED = re.compile(r"[\s\[\]]*\d{1,4}-\d{1,2}-\d{1,2}(?![^\s\[\]])")
_PIECE = r"[\s\[\]]+([^\s\[\]]+)"
#: The first six pieces of a line.
_PIECES = re.compile(r"[\s\[\]]*([^\s\[\]]+)" + f"(?:{_PIECE}" * 5 + ")?" * 5)
_TIME = re.compile(r"\d{1,2}:\d{1,2}:\d{1,2}(?:[.:]\d+)?$")


def log_line(line: str) -> tuple[str, str, str, str] | None:
    """(time, level, category, message) of a line that begins an entry: a date, perhaps a time, a level, a category."""
    if not _DATED.match(line, 0, 400):
        return None
    found = _PIECES.match(line, 0, 400)
    pieces = found.groups()
    k, time = 1, pieces[0]
    if pieces[1] is not None:
        if _TIME.match(pieces[1]):
            time, k = f"{time} {pieces[1]}", 2
        elif pieces[1][0].isdigit():
            return None
    level = pieces[k] or ""
    k += 1
    category = ""
    if pieces[k + 1] == "-":
        category = pieces[k]
        k += 2
    if pieces[k] is None:
        return time, level, category, ""
    return time, level, category, line[found.start(k + 1) :].rstrip()


_BRACES = re.compile("[{}]")


def embedded_json(message: str) -> tuple[str, str]:
    """The first balanced ``{...}`` of a message, and the message without it."""
    start = message.find("{")
    if start < 0:
        return "", message
    depth = 0
    for brace in _BRACES.finditer(message, start):
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            at = brace.start()
            return message[start : at + 1], (message[:start].rstrip() + " " + message[at + 1 :].lstrip()).strip()
    return "", message


_LINE = re.compile(r"([^\r\n]*)(?:\r\n|\n|\r|\Z)")


def log_entries(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(line, time, level, category, message) of a log; lines that begin no entry go on with the one before."""
    held, further = None, []
    for number, found in enumerate(_LINE.finditer(text), 1):
        line = found[1]
        if entry := log_line(line):
            if held:
                yield (*held[:4], "\n".join([held[4], *further])) if further else held
            held, further = (number, *entry), []
        elif held and line.strip():
            further.append(line)
    if held:
        yield (*held[:4], "\n".join([held[4], *further])) if further else held


def log_events(text: str) -> Iterator[Event]:
    """Events of a log: a ``row`` for each entry, the properties of JSON in its message as further elements.

    ``TRACE START`` keeps its row open as a scope for what follows, ``END`` closes it, ``ROOT`` closes all scopes.
    """
    scopes = 0
    yield "start", "log", {}, 1
    for line, time, level, category, message in log_entries(text):
        trace = category or message.split(" ")[0]
        if level == "TRACE" and trace == "ROOT":
            for _ in range(scopes):
                yield "end", "row"
            scopes = 0
        yield "start", "row", {}, line
        found, rest = embedded_json(message)
        yield "leaf", "time", time, line
        yield "leaf", "level", level, line
        yield "leaf", "category", category, line
        if found:
            try:
                inner = list(json_events(found))
            except SpecError:
                inner, rest = [], message
            yield from inner[1:-1]  # without the root
        yield "leaf", "msg", rest, line
        if level == "TRACE" and trace == "START":
            scopes += 1
            continue
        yield "end", "row"
        if level == "TRACE" and trace == "END" and scopes:
            yield "end", "row"
            scopes -= 1
    for _ in range(scopes):
        yield "end", "row"
    yield "end", "log"


def column_names(header: list[str | None], width: int) -> list[str]:
    """Names of so many columns: the header's, then numbers; a name that is taken gets an underscore in front."""
    names: list[str] = []
    for k in range(width):
        given = header[k] if k < len(header) else None
        name = re.sub(r"[\x00-\x1f]", "_", given) if given else str(k + 1)
        while name.lower() in (n.lower() for n in names) or (
            not given and any(name == (h or "") for h in header[k + 1 :])
        ):
            name = "_" + name
        names.append(name)
    return names


def delimited_events(text: str, sep: str = ",", header: bool = True) -> Iterator[Event]:
    """Events of delimited text: a ``row`` for each record, an element for each field.

    Short records are padded to the columns known so far; further fields make new, numbered columns.
    """
    unix = re.sub(r"\r\n|\r", "\n", text)
    if unix.endswith("\n"):
        unix = unix[:-1]
    reader = csv.reader(io.StringIO(unix.replace('\\"', '""')), delimiter=sep, strict=False)
    given = next(reader, []) if header else []
    names = column_names(given, len(given))
    yield "start", "csv", {}, 1
    for record in reader:
        if len(record) > len(names):
            names = column_names([*names, *[None] * (len(record) - len(names))], len(record))
        yield "start", "row", {}, reader.line_num
        for name, value in zip(names, [*record, *[""] * (len(names) - len(record))]):
            yield "leaf", name, value, reader.line_num
        yield "end", "row"
    yield "end", "csv"


EVENTS = {
    "xml": xml_events,
    "json": json_events,
    "log": log_events,
    "csv": delimited_events,
    "tsv": partial(delimited_events, sep="\t"),
    "csv-plain": partial(delimited_events, header=False),
    "tsv-plain": partial(delimited_events, sep="\t", header=False),
}


@dataclass(frozen=True)
class Wanted:
    """What a query takes from documents: paths with their text, and facts about paths' elements."""

    paths: tuple[tuple[str, ...], ...]
    #: (fact, path, argument): attr, path, depth, nodename, nodenum, nodestart, nodeend, linenum.
    facts: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    sync: tuple[tuple[str, ...], ...] = ()
    root: int = 0
    case: bool = False

    @property
    def names(self) -> list[str]:
        return [f"p{k}" for k in range(len(self.paths))] + [f"f{k}" for k in range(len(self.facts))]


def path_pattern(parts: tuple[str, ...], case: bool) -> re.Pattern:
    """Expression for an ancestor chain written as ``/a/b/c``."""
    out, k, parts = "(?:/[^/]*)*", 0, list(parts)
    while parts and parts[0] == "*" and len(parts) > 1:
        parts.pop(0)
    while k < len(parts):
        if parts[k] == "*":
            n = 1
            while k + n < len(parts) and parts[k + n] == "*":
                n += 1
            last = k + n == len(parts)
            # Inner stars: any number of levels, one more for each further star.  Final stars: one level each.
            out += "/[^/]*" * (n if last else n - 1) + ("" if last else "(?:/[^/]*)*")
            k += n
        else:
            out += "/" + re.escape(parts[k])
            k += 1
    return re.compile(out, 0 if case else re.IGNORECASE)


@dataclass(slots=True)
class _Path:
    parts: tuple[str, ...]
    pattern: re.Pattern
    data: bool
    is_sync: bool
    state: str = "search"
    order: int | None = None
    value: str | None = None
    depth: int = 0
    text: list[str] = field(default_factory=list)
    facts: list[tuple[int, str, str]] = field(default_factory=list)


class Matcher:
    """Rows of a document's events: a list of values for each, partition last (see ``Partitioner``).

    One matcher serves any number of documents, one after another.
    """

    def __init__(self, wanted: Wanted):
        self.wanted = wanted
        every = dict.fromkeys([*wanted.paths, *(f[1] for f in wanted.facts), *wanted.sync])
        self.paths = {
            parts: _Path(parts, path_pattern(parts, wanted.case), parts in wanted.paths, parts in wanted.sync) for parts in every
        }
        self.facts: list[str] = [""] * len(wanted.facts)
        for k, (fact, parts, argument) in enumerate(wanted.facts):
            self.paths[parts].facts.append((k, fact, argument))
        self._memo: dict[str, list[_Path]] = {}

    def _matching(self, chain: str) -> list[_Path]:
        found = self._memo.get(chain)
        if found is None:
            if len(self._memo) > 10_000:
                self._memo.clear()
            found = self._memo[chain] = [p for p in self.paths.values() if p.pattern.fullmatch(chain)]
        return found

    def rows(self, events: Iterator[Event]) -> Iterator[list]:
        names: list[str] = []
        numbers: list[int] = []
        attrs: list[dict[str, str]] = []
        chains = [""]
        paths = list(self.paths.values())
        for p in paths:
            p.state, p.order, p.value, p.depth, p.text = "search", None, None, 0, []
        self.facts = [""] * len(self.wanted.facts)
        counter, node, root, inside = 0, 0, self.wanted.root, self.wanted.root == 0
        root_depth, top, plain = 0, 0, not self.wanted.facts and not self.wanted.root
        self.matched: set[tuple[str, ...]] = set()
        parts, sync = Partitioner(), bool(self.wanted.sync)
        wanted = [self.paths[w] for w in self.wanted.paths]
        memo = self._memo
        opened: list[_Path] = []
        for event in events:
            kind = event[0]
            leaf = kind == "leaf"
            if leaf or kind == "start":
                node += 1
                name = event[1]
                chain = f"{chains[-1]}/{name}"
                found = memo.get(chain)
                if found is None:
                    found = self._matching(chain)
                if leaf and not found and not opened and node != root:
                    # An element that nothing asks for.
                    depth = len(names) + 1
                    if depth <= parts.depth:
                        parts.end(depth)
                    continue
                if leaf and plain and not opened:
                    # As below, for an element that begins and ends at once, and within nothing that is open.
                    ended, synced, value = False, False, None
                    for p in found:
                        if p.state == "search":
                            self.matched.add(p.parts)
                            if p.order is None:
                                p.order = counter
                            counter, ended = p.order + 1, True
                            p.state = "open"
                    if ended:
                        top = counter if counter > top else top
                        if counter < top:
                            for p in paths:
                                if p.order is not None and p.order >= counter:
                                    p.state, p.order, p.value = "search", None, None
                            top = counter
                        for p in found:
                            if p.state == "open":
                                if value is None:
                                    value = escaped(event[2].strip())
                                p.value, p.state = value if p.data else "", "found"
                                synced = synced or p.is_sync
                        whole = synced
                        if not sync:
                            whole = True
                            for p in paths:
                                if p.value is None:
                                    whole = False
                                    break
                        if whole:
                            yield [*[decoded(p.value or "") for p in wanted], parts.row(len(names) + 1)]
                            for p in paths:
                                if p.state == "found":
                                    p.state = "search"
                    depth = len(names) + 1
                    if depth <= parts.depth:
                        parts.end(depth)
                    continue
                names.append(name), numbers.append(node), attrs.append({} if leaf else event[2]), chains.append(chain)
                if node == root:
                    inside, root_depth = True, len(names)
                if inside:
                    if opened:
                        shown = f"<{name}>"
                        if not leaf and event[2]:
                            shown = f"<{name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in event[2].items()) + ">"
                        for p in opened:
                            if p.data:
                                p.text.append(shown)
                    hit = False
                    for p in found:
                        if p.state != "search":
                            continue
                        self.matched.add(p.parts)
                        if p.order is None:
                            p.order = counter
                        counter, hit = p.order + 1, True
                        top = counter if counter > top else top
                        p.state, p.depth, p.text = "open", len(names), []
                        p.value = None if p.data or p.is_sync else ""
                        opened.append(p)
                        for k, fact, argument in p.facts:
                            self.facts[k] = self._fact(fact, argument, names, numbers, attrs, event[3])
                    if hit and counter < top:
                        top = counter
                        for p in paths:
                            if p.order is not None and p.order >= counter:
                                if p.state == "open":
                                    opened.remove(p)
                                p.state, p.order, p.value, p.text = "search", None, None, []
                                for k, _, _ in p.facts:
                                    self.facts[k] = ""
                    if leaf and opened:
                        text = escaped(event[2])
                        for p in opened:
                            if p.data:
                                p.text.append(text)
                if not leaf:
                    continue
            elif kind == "text":
                if opened and inside:
                    for p in opened:
                        if p.data:
                            p.text.append(event[1])
                continue
            # An element ends.
            if not names:
                continue
            depth = len(names)
            if opened:
                ended, synced = False, False
                for p in opened:
                    if p.depth == depth:
                        p.value = "".join(p.text).strip()
                        p.state, p.text, ended = "found", [], True
                        synced = synced or p.is_sync
                        for k, fact, _ in p.facts:
                            if fact == "nodeend":
                                self.facts[k] = str(node)
                    elif p.data:
                        p.text.append(f"</{names[-1]}>")
                if ended:
                    opened = [p for p in opened if p.state == "open"]
                    whole = synced
                    if not sync:
                        whole = True
                        for p in paths:
                            if p.value is None:
                                whole = False
                                break
                    if whole:
                        yield [*[decoded(p.value or "") for p in wanted], *self.facts, parts.row(depth)]
                        for p in paths:
                            if p.state == "found":
                                p.state = "search"
            names.pop(), numbers.pop(), attrs.pop(), chains.pop()
            if depth <= parts.depth:
                parts.end(depth)
            if root and inside and depth - 1 < root_depth:
                return

    @staticmethod
    def _fact(fact: str, argument: str, names: list[str], numbers: list[int], attrs: list[dict], line: int) -> str:
        up = int(argument) if argument.isdigit() else 0
        if fact == "attr":
            wanted = argument.lower()
            for own in reversed(attrs):
                for name, value in own.items():
                    if name.lower() == wanted:
                        return value
            return ""
        if fact == "path":
            return ".".join(names[:-1])
        if fact == "depth":
            return str(len(names) - 1)
        if fact == "nodename":
            return names[-1 - up] if up < len(names) else ""
        if fact == "nodenum":
            if argument and not argument.isdigit():
                for name, number in zip(reversed(names), reversed(numbers)):
                    if name.lower() == argument.lower():
                        return str(number)
                return "0"
            return str(numbers[-1 - up] if up < len(names) else 0)
        if fact == "linenum":
            return str(line)
        return str(numbers[-1]) if fact == "nodestart" else ""


class Partitioner:
    """Numbers the partitions whose rows a pivot joins: the elements that enclose the first two rows' elements."""

    def __init__(self):
        self.part, self.rows, self.depth = 0, 0, 0

    def row(self, depth: int) -> int:
        if self.rows == 0:
            self.depth = depth - 1
        self.rows += 1
        return self.part

    def end(self, depth: int) -> None:
        """An element of this depth has ended."""
        if not self.rows:
            return
        if self.rows < 2 and self.part == 0 and depth <= self.depth:
            self.depth = min(self.depth, depth - 1)
            return
        if depth <= self.depth:
            self.part += 1
            self.rows = 2 if self.part else 0


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of whole files, numbered by name."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return files.select(F.xxhash64("file").alias("doc"), "text")


def _one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """Texts of a column, of which one is held at a time."""
    for text in texts:
        yield text.as_py()


def shown(events: Iterator[Event]) -> str:
    """A document's events as XML text: an element to a line, further in by its depth."""
    lines: list[str] = []
    depth, text, leaf = 0, "", False
    for event in events:
        if event[0] == "start":
            own = "".join(f' {k}="{html.escape(v)}"' for k, v in event[2].items())
            lines.append(f"{'  ' * depth}<{event[1]}{own}>")
            depth, text, leaf = depth + 1, "", True
        elif event[0] == "text":
            text += event[1]
        elif event[0] == "leaf":
            lines.append(f"{'  ' * depth}<{event[1]}>{escaped(event[2]).strip()}</{event[1]}>")
            leaf = False
        else:
            depth -= 1
            end = f"</{event[1]}>"
            if leaf:
                lines[-1] += text.strip() + end
            else:
                lines.append("  " * depth + end)
            leaf = False
    return "\n".join(lines)


def echo(docs: DataFrame, kind: str) -> DataFrame:
    """Documents (doc, text) as XML text (xml): XML as it is, others by their events."""
    if kind == "xml":
        return docs.select(F.col("text").alias("xml"))

    def run(batches):
        for batch in batches:
            for text in _one_by_one(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([shown(EVENTS[kind](text or ""))])], ["xml"])

    return docs.select("text").mapInArrow(run, "xml string")


def extract(docs: DataFrame, kind: str, wanted: Wanted) -> DataFrame:
    """Rows of documents (doc, text): text columns p0.. and f0.., ``part``, and ``ord`` (document, then place in it)."""
    names = wanted.names

    def run(batches):
        matcher, rows = Matcher(wanted), []
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), _one_by_one(batch.column("text"))):
                for place, row in enumerate(matcher.rows(EVENTS[kind](text or ""))):
                    rows.append((*row, doc, place))
                    if len(rows) >= 10_000:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    def made(rows):
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.string()) for c in columns[: len(names)]]
        arrays += [pa.array(c, pa.int64()) for c in columns[len(names) :]]
        return pa.RecordBatch.from_arrays(arrays, [*names, "part", "doc", "place"])

    schema = ", ".join([f"{n} string" for n in names] + ["part long", "doc long", "place long"])
    found = docs.select("doc", "text").mapInArrow(run, schema)
    return found.select(
        *names, F.struct("doc", "part").alias("part"), F.struct("doc", "place").alias("ord")
    )


def unmatched_paths(docs: DataFrame, kind: str, wanted: Wanted) -> list[tuple[str, ...]]:
    """Paths that no element of any document matches."""

    def run(batches):
        matcher, matched = Matcher(wanted), set()
        for batch in batches:
            for text in _one_by_one(batch.column("text")):
                for _ in matcher.rows(EVENTS[kind](text or "")):
                    pass
                matched |= matcher.matched
        found = [k for k, parts in enumerate(matcher.paths) if parts in matched]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["k"])

    found = {r["k"] for r in docs.select("text").mapInArrow(run, "k int").distinct().collect()}
    return [parts for k, parts in enumerate(Matcher(wanted).paths) if k not in found]
