"""Secret scan with a recursive decoding worklist.

The text itself is the first layer. Scanning a layer finds secrets of three kinds and encoded segments:
percent escapes, Unicode escapes, base64, and compressed data inside base64. Each segment, decoded, is
a new layer on the worklist. A layer that was met before is not entered again, so cycles end and the
list runs dry. A layer carries the place of each of its characters in the original text (for escapes
character by character, for base64 and compressed data the whole segment), and what is found in it is
reported there.

Documents are independent: one pass, no shuffle, memory of one document's layers at a time.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of kinds where spans begin together.
KINDS = ("assign", "access", "hex")
#: Bytes one decompressed layer is held at once. A larger one (a decompression bomb) is counted in
#: ``n_oversize`` and read in overlapping pieces; the text itself has no such limit.
MAX_LAYER = 32_000_000

#: The patterns of the three kinds.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "api")

_LONG = re.compile(r"[^\s]{20,}")
_LONG64 = re.compile(r"[^\s]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines; the last one may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
#: How base64 of compressed data begins.
_PACKED = re.compile(r"(?=H4sI|Qlpo|/Td6WFo|e[AFJN])")
#: Characters between bytes that are no text; shorter ones hold no secret and no encoded one.
_PRINTABLE = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]{12,}")

Span = tuple[str, int, int]


def scan(text: str) -> Iterator[Span]:
    """Secrets of one layer: leftmost matches of each kind that do not overlap; failing ones are
    passed over."""
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for token in _LONG.finditer(text):
        for m in _HEX.finditer(text, token.start(), token.end()):
            yield "hex", m.start(), m.end()


class Layer:
    """A decoded text and, per character, where it stands in the original: ``begin[i]:end[i]``, or one
    span for all characters."""

    def __init__(self, text: str, begin: list[int] | None, end: list[int] | None, whole: tuple[int, int] | None):
        self.text, self.begin, self.end, self.whole = text, begin, end, whole
        self.piece = self.oversize = False  # a piece of an oversize layer; the first of them

    def original(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.begin is None:
            return start, end
        return self.begin[start], self.end[end - 1]


def _spliced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer with the segments ``(start, end, decoded)`` put in place."""
    text, begin, end, at = [], [], [], 0

    def literal(stop: int) -> None:
        text.append(layer.text[at:stop])
        for i in range(at, stop):
            b, e = layer.original(i, i + 1)
            begin.append(b)
            end.append(e)

    for start, stop, decoded in pieces:
        literal(start)
        b, e = layer.original(start, stop)
        text.append(decoded)
        begin.extend([b] * len(decoded))
        end.extend([e] * len(decoded))
        at = stop
    literal(len(layer.text))
    if layer.whole:
        return Layer("".join(text), None, None, layer.whole)
    return Layer("".join(text), begin, end, None)


def _unescape(match: str) -> str:
    digits = match.strip("\\&#;{}uUxX")
    number = int(digits, 10 if match.startswith("&#") and match[2] not in "xX" else 16)
    return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else ""


def _readable(data: bytes) -> str | None:
    """The text in ``data``: UTF-8 with hardly any control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if c < " " and c not in "\t\n\r" or c == "\x7f")
    return text if text and odd * 20 <= len(text) else None


def _text(data: bytes) -> str | None:
    """The text in ``data``, or else its parts that are text, a line each."""
    text = _readable(data)
    if text is None:
        text = "\n".join(_PRINTABLE.findall(data.decode(errors="replace")))
    return text or None


#: Bytes that decompression gives at a time, and what pieces of a large layer share.
_CHUNK, _SHARED = 1 << 20, 1 << 20


def _maker(data: bytes):
    if data[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the gzip, zlib, bzip2 or xz members in ``chunks`` hold, up to a fault or other data."""
    member, rest = None, b""
    for chunk in chunks:
        rest += chunk
        while rest or member is not None:
            if member is None:
                if len(rest) < 6:
                    break  # more comes, or nothing
                make = _maker(rest)
                if make is None:
                    return
                member = make()
            try:
                out = member.decompress(rest, _CHUNK)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            if out:
                yield out
            if member.eof:
                rest, member = member.unused_data, None
                continue
            rest = getattr(member, "unconsumed_tail", b"")
            if not rest and len(out) < _CHUNK and getattr(member, "needs_input", True):
                break


def _decompressed(data: bytes) -> Iterator[bytes] | None:
    """Chunks of what compressed ``data`` holds, also inside compressed data; None for other data."""
    chunks: Iterator[bytes] = iter((data,))
    for depth in range(64):
        first = next(chunks, b"")
        while depth and 0 < len(first) < 6 and (more := next(chunks, b"")):
            first += more
        if _maker(first) is None:
            return chain((first,), chunks) if depth else None
        inner = _inflated(chain((first,), chunks))
        head = next(inner, None)
        if head is None:  # not compressed after all
            return chain((first,), chunks) if depth else None
        chunks = chain((head,), inner)
    return chunks


def _pieces(data: bytes) -> Iterator[tuple[str, bool]]:
    """Texts in decoded ``data``, and whether each is a piece of a layer beyond ``MAX_LAYER``."""
    chunks = _decompressed(data)
    if chunks is None:
        text = _text(data)
        if text is not None:
            yield text, False
        return
    held, size, large = [], 0, False
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size > MAX_LAYER:
            large = True
            whole = b"".join(held)
            yield _text(whole) or "", True
            held = [whole[-min(_SHARED, MAX_LAYER // 2):]]
            size = len(held[0])
    text = _text(b"".join(held))
    if text is not None:
        yield text, large


def _decoded(body: str) -> bytes:
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _from_base64(segment: str) -> Iterator[tuple[str, bool]]:
    """Texts in a run of base64 characters: from its start, from the other three alignments (other
    characters may stand before the encoded part), from the parts between separators that are base64
    characters too, and from wherever compressed data may begin."""
    run = segment.rstrip("=")
    body = run.replace("-", "+").replace("_", "/")
    for start in range(4):
        if len(body) - start >= 16:
            data = _decoded(body[start:])
            if start == 0 or _maker(data) is None:
                yield from _pieces(data)
    for part in re.finditer(r"[^/_-]{16,}", run):
        if len(part.group()) < len(run):
            yield from _pieces(_decoded(part.group()))
    for m in _PACKED.finditer(body):
        at, width = m.start(), 64
        if at == 0:
            continue
        # Longer and longer parts: where no compressed data begins, a fault shows early.
        while at + width < len(body) and _sound(_decoded(body[at:at + width])):
            width *= 16
        if at + width >= len(body):
            data = _decoded(body[at:])
            if _decompressed(data) is not None:
                yield from _pieces(data)
        elif _decompressed(_decoded(body[at:at + width])) is not None:  # other data follows
            yield from _pieces(_decoded(body[at:at + width]))


def _sound(data: bytes) -> bool:
    """Whether ``data`` begins compressed data without a fault or an end."""
    make = _maker(data)
    if make is None:
        return False
    member = make()
    try:
        member.decompress(data, _CHUNK)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return False
    return not member.eof


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside ``layer``; one beyond the limit comes in pieces."""
    text = layer.text
    if "%" in text:
        pieces = []
        for m in _PERCENT.finditer(text):
            data = bytes.fromhex(m.group().replace("%", ""))
            pieces.append((m.start(), m.end(), data.decode(errors="replace")))
        if pieces:
            yield _spliced(layer, pieces)
    if "\\u" in text or "\\x" in text or "&#" in text:
        pieces = [(m.start(), m.end(), _unescape(m.group())) for m in _ESCAPE.finditer(text)]
        if pieces:
            yield _spliced(layer, pieces)
    for token in _LONG64.finditer(text):
        for m in _BASE64.finditer(text, token.start(), token.end()):
            yield from _inner(layer, m, m.group())
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            yield from _inner(layer, m, _BREAK.sub("", m.group()))


def _inner(layer: Layer, found: re.Match, segment: str) -> Iterator[Layer]:
    large = False
    for text, piece in _from_base64(segment):
        inner = Layer(text, None, None, layer.original(found.start(), found.end()))
        inner.piece, inner.oversize = piece, piece and not large
        large = piece
        yield inner


def find(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Spans of the text itself, spans of all layers, number of layers, number of oversize ones."""
    base = list(scan(text))
    every = set(base)
    seen, layers, oversize = {sha256(text.encode(errors="replace")).digest()}, 1, 0
    work = [unwrap(Layer(text, None, None, None))]  # the innermost first, so that few layers are held
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        oversize += layer.oversize
        digest = sha256(f"{layer.whole}:{layer.text}".encode(errors="replace")).digest()
        if digest in seen or not layer.text:
            continue
        seen.add(digest)
        layers += not layer.piece or layer.oversize
        for kind, start, end in scan(layer.text):
            every.add((kind, *layer.original(start, end)))
        work.append(unwrap(layer))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(every, key=order), layers, oversize


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _spans(docs: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in docs], kind)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans, n_layers, n_oversize)``: per document the spans of its plain text and
    those of all layers, in code points of the text, end exclusive.

    Null and empty texts have none; repeated rows and null ids are rows like others; equal spans are
    one; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _spans([f[0] for f in found]), _spans([f[1] for f in found]),
                 pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                ["doc_id", "base", "spans", "n_layers", "n_oversize"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}, n_layers int, n_oversize int")


def joined(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark`` (overlapping spans by one). A null
    text stays null; all rows and columns stay as they are."""
    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        spans = sorted((s, e) for _, s, e in find(text)[1])
        for start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]

    fields = [f.name for f in docs.schema.fields]
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            at = fields.index(text_col)
            columns[at] = pa.array([clean(t.as_py()) for t in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, fields)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, kinds)
