"""Secret scans over every layer of a text.

The worklist begins with the whole text. Each layer is scanned; then its encoded stretches are unwrapped and each
becomes a layer of its own: runs with percent escapes, runs with Unicode or hexadecimal escapes, base64 (both
alphabets, with or without padding, at all four alignments, each line and lines joined), and what zlib, gzip or bzip2 compressed, wherever it begins in the bytes of any
of these or of another stream's start. Bytes that aren't UTF-8 become replacement characters and the rest is scanned.
A layer whose content was seen before in this document isn't entered again, so the worklist ends at its fixpoint;
nothing else bounds its depth.

Every layer keeps, for each of its characters, where that character came from in the document: escapes and base64
map character by character, a compressed stretch maps as a whole. A match in an inner layer is reported with its
kind and the span of the document's characters that carry it, unless the document itself shows that very span.

Decompression goes piece by piece, through all members of a stream: what unfolds to more than ``PIECE`` bytes is
scanned in overlapping pieces, and a layer's pieces and inner layers are made one at a time, so memory stays bounded
and nothing of it is left out.

Defined cases: a null or empty text has no spans; a match's span covers the whole match, ends exclusive, in code
points; equal spans of one kind are reported once; repeated rows are scanned row by row; other columns are dropped.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Generator, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from textward.llm.common import bound_batches, texts

#: The kinds in their order, their patterns and the least length (of the value or the match).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

HEXED = re.compile("%([0-9A-Fa-f]{2})")
PERCENT = re.compile(r"(?<![!-~])[!-~]*%[0-9A-Fa-f]{2}[!-~]*")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};)")
#: As in literals of bytes: the short escapes too.
SHORT = {"\\a": "\a", "\\b": "\b", "\\t": "\t", "\\n": "\n", "\\v": "\v", "\\f": "\f", "\\r": "\r", "\\0": "\0", "\\'": "'", '\\"': '"', "\\/": "/", "\\\\": "\\"}
LITERAL = re.compile(ESCAPED.pattern + r"|\\[abtnvfr0'\"/\\]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
#: A single line break, itself or spelled, with the indentation around it; runs joined by such.
BREAK = re.compile(r"[ \t]*(?:\r\n|\n|\r|(?:\\r)?\\n)[ \t]*")
JOINED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
STRAY = re.compile("[\udc80-\udcff]")
#: How gzip, bzip2 and zlib streams begin, how much of them tells, and a part of that in text.
HEAD = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|x[\x01^\x9c\xda]")
HEAD_BYTES = 10
HEAD_TEXT = re.compile("\x1f\x8b|BZh[1-9]|x[\x01^\x9c\xda]")
#: Characters of one layer of a decompressed stream, and how far two such pieces overlap.
PIECE, OVERLAP = 4 << 20, 64 << 10

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


class Layer:
    """Text, and where each of its characters (or bytes, if it was spelled from bytes) is in the layer around it."""

    __slots__ = ("_ends", "parent", "place", "raw", "text")

    def __init__(self, text: str, parent: Layer | None = None, place: Callable[[int], tuple[int, int]] | None = None, raw: str | None = None):
        self.text, self.parent, self.place = text, parent, place
        self.raw, self._ends = raw, None

    def unit(self, k: int) -> int:
        """The byte at which character ``k`` begins."""
        if self.raw is None or self.raw.isascii():
            return k
        if self._ends is None:
            self._ends = [0, *accumulate(len(c.encode("utf-8", "surrogateescape")) for c in self.raw)]
        return self._ends[k]

    def span(self, begin: int, end: int) -> tuple[int, int]:
        """The span of the document's characters that carry those of this layer."""
        layer = self
        while layer.parent is not None:
            begin, end = layer.place(layer.unit(begin))[0], layer.place(layer.unit(end) - 1)[1]
            layer = layer.parent
        return begin, end


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches of one layer."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _spelled(data: bytes, parent: Layer, place: Callable[[int], tuple[int, int]]) -> Layer:
    """Bytes as a layer of UTF-8, each that isn't as a replacement character; ``place`` has where each is in ``parent``."""
    raw = data.decode("utf-8", "surrogateescape")
    return Layer(STRAY.sub("\ufffd", raw), parent, place, raw)


def _between(starts: list[int]) -> Callable[[int], tuple[int, int]]:
    return lambda k: (starts[k], starts[k + 1])


def _unpercent(layer: Layer) -> Iterator[Layer]:
    for m in PERCENT.finditer(layer.text) if "%" in layer.text else ():
        run, data, starts, i = m[0], bytearray(), [], 0
        for e in HEXED.finditer(run):
            data += run[i : e.start()].encode("ascii")
            starts += range(m.start() + i, m.start() + e.start())
            data.append(int(e[1], 16))
            starts.append(m.start() + e.start())
            i = e.end()
        data += run[i:].encode("ascii")
        starts += range(m.start() + i, m.end() + 1)
        yield _spelled(bytes(data), layer, _between(starts))
        yield from _packed(bytes(data), layer, starts)


def _character(escape: str) -> str:
    if escape in SHORT:
        return SHORT[escape]
    digits = escape.strip("\\uUx{}&#;")
    code = int(digits, 10 if escape.startswith("&#") and escape[2] != "x" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unescaped(line: re.Match[str], escapes: re.Pattern[str]) -> tuple[str, list[int]]:
    """A line without its escapes, and where each character begins and the last ends."""
    out, starts, i = [], [], 0
    for m in escapes.finditer(line[0]):
        out.append(line[0][i : m.start()])
        starts += range(line.start() + i, line.start() + m.start())
        out.append(_character(m[0]))
        starts.append(line.start() + m.start())
        i = m.end()
    out.append(line[0][i:])
    starts += range(line.start() + i, line.end() + 1)
    return "".join(out), starts


def _unescape(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    for line in re.finditer(r"[^\n]+", layer.text):
        if not ESCAPED.search(line[0]):
            continue
        text, starts = _unescaped(line, ESCAPED)
        yield Layer(text, layer, _between(starts))
        if not HEAD_TEXT.search(text):
            continue
        for escapes in (ESCAPED, LITERAL):
            text, starts = _unescaped(line, escapes)
            # a character beyond a byte ends a compressed stretch
            for m in re.finditer("[\0-\xff]+", text):
                yield from _packed(m[0].encode("latin-1"), layer, starts[m.start() : m.end() + 1])


def _opened(data: bytes | memoryview):
    """What decompresses a stream that begins so; None if it isn't one."""
    head = HEAD.match(data)
    if head is None:
        return None
    return bz2.BZ2Decompressor() if head[0].startswith(b"B") else zlib.decompressobj(31 if head[0].startswith(b"\x1f") else 15)


def _inflate(chunks: Iterator[bytes | memoryview]) -> Generator[bytes, None, int | None]:
    """The pieces of a compressed stream, of all its members; none if it isn't one.

    Returns how many bytes of the last chunk are left behind the members, None if the last of them has no end.
    """
    data, left = b"", None
    while True:
        while len(data) < HEAD_BYTES and (more := next(chunks, None)) is not None:
            data = b"".join((data, more)) if data else more
        if (machine := _opened(data)) is None:
            return left
        try:
            while not machine.eof:
                # what a machine still holds comes out with no input: bzip2 has no unconsumed_tail at all
                piece = machine.decompress(data, PIECE)
                data = getattr(machine, "unconsumed_tail", b"")
                if piece:
                    yield piece
                elif not machine.eof and (data := next(chunks, None)) is None:
                    return None
        except (zlib.error, OSError):
            return left
        left = len(machine.unused_data)
        data = machine.unused_data.lstrip(b"\0")


def _extent(data: memoryview) -> tuple[int, bool]:
    """The length of the compressed stream at the start (0: none), and whether it ends."""
    pieces, some = _inflate(iter((data,))), False
    while True:
        try:
            some |= bool(next(pieces))
        except StopIteration as end:
            return (len(data) - (end.value or 0) if some else 0), end.value is not None


def _packed(data: bytes, parent: Layer, starts: Sequence[int], ended: set[int] | None = None) -> Iterator[Layer]:
    """The compressed streams anywhere in ``data`` as layers; each maps as a whole. ``starts`` has the bytes' places in ``parent`` and their end.

    Streams that begin at a place in ``ended`` were seen to their end before; those of ``data`` are added.
    """
    at = 0
    while head := HEAD.search(data, at):
        at = head.start() + 1
        if ended and starts[head.start()] in ended:
            continue
        stream = memoryview(data)[head.start() :]
        length, ends = _extent(stream)
        if length:
            yield from _unfolded(stream[:length], parent, (starts[head.start()], starts[head.start() + length]))
            if ends:
                at = head.start() + length
                if ended is not None:
                    ended.add(starts[head.start()])


def _unfolded(data: bytes | memoryview, parent: Layer, place: tuple[int, int]) -> Iterator[Layer]:
    """The pieces of a stream as overlapping layers, then those of a stream that is all its content, and so on."""
    depth, contents = 1, set()
    while True:
        pieces = iter((data,))
        for _ in range(depth):
            pieces = _inflate(pieces)
        decode, tail, mark, size, first = codecs.getincrementaldecoder("utf-8")("replace").decode, "", hashlib.blake2b(digest_size=16), 0, b""
        for piece in pieces:
            text = tail + decode(piece)
            yield Layer(text, parent, lambda _: place)
            tail = text[-OVERLAP:]
            mark.update(piece)
            size += len(piece)
            if size <= PIECE:
                first += piece
        if HEAD.match(first) is None or mark.digest() in contents:
            return
        contents.add(mark.digest())
        data, depth = (first, 1) if size <= PIECE else (data, depth + 1)


def _runs(text: str) -> Iterator[tuple[str, Sequence[int], int]]:
    """Base64 runs, those joined over line breaks first: the letters, where each is, and the end with its padding."""
    for m in JOINED.finditer(text):
        if BASE64.search(m[0]):
            lines = [(x.start() + m.start(), x[0]) for x in LETTERS.finditer(BREAK.sub(lambda x: " " * len(x[0]), m[0]))]
            yield "".join(x for _, x in lines), [k for at, x in lines for k in range(at, at + len(x))], m.end()
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield run, range(m.start(), m.start() + len(run)), m.end()


def _unbase64(layer: Layer) -> Iterator[Layer]:
    ended: set[int] = set()
    for letters, places, end in _runs(layer.text):
        letters = letters.replace("-", "+").replace("_", "/")
        # what is glued to the front shifts the rest: one of four alignments has it, wherever it begins
        for shift in range(4):
            run, at = letters[shift:], places[shift:]
            if len(run) % 4 == 1:
                run = run[:-1]
            data = base64.b64decode(run + "=" * (-len(run) % 4))
            yield _spelled(data, layer, lambda k, at=at, n=len(run): (at[k // 3 * 4 + k % 3], at[min(k // 3 * 4 + k % 3 + 1, n - 1)] + 1))
            if HEAD.search(data):
                yield from _packed(data, layer, [*(at[k // 3 * 4 + k % 3] for k in range(len(data))), end], ended)


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    for unwrap in (_unpercent, _unescape, _unbase64):
        yield from unwrap(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """The base spans, all spans, and the number of layers."""
    shown = base(text)
    found = set(shown)
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work, layers = [_unwrapped(Layer(text))], 1
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if not inner.text:
            continue
        mark = hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass") + repr(inner.span(0, 1)).encode(), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        for b, k, e in base(inner.text):
            start, end = inner.span(b, e)
            found.add((start, k, end))
        work.append(_unwrapped(inner))
    return shown, sorted(found), layers


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (all, as kind:start:end) and n_layers of every whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == n for _, k, _ in r[0]) for r in rows], pa.int64()) for n in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), *counts, pa.array([hashlib.sha256(spelled(r[0]).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([spelled(r[1]) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
            )

    return texts(docs).mapInArrow(run, SPANS)
