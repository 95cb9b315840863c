"""Secrets in plain and encoded text: a worklist of layers, each scanned and unwrapped until nothing new appears.

A layer is a piece of text with the source range of every character. Escapes
(percent, backslash-u and -x, numeric character references) give a layer in
which they are replaced; runs of base64 give their bytes, which give text or, if
compressed, further bytes. A layer that was there before, with the same content
and source, is not entered again. Matches in any layer are reported where their characters came
from in the document, in code points.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}  # characters of the value, of the whole match for the others
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: an escape; the percent sign, backslash or ampersand of it may itself be escaped in the same way any number of times
ESCAPE = re.compile(r"%(?:25)*(?P<pct>[0-9A-Fa-f]{2})|(?<!\\)\\++(?:u(?P<u4>[0-9A-Fa-f]{4})|u\{0*(?P<ub>[0-9A-Fa-f]{1,6})\}|U(?P<u8>[0-9A-Fa-f]{8})|x(?P<x>[0-9A-Fa-f]{2}))|&(?:amp;)*#(?:[xX]0*(?P<hx>[0-9A-Fa-f]{1,6})|0*(?P<dec>[0-9]{1,7}));")
#: no match, escape or base64 run contains one of these characters, so what stands between two of them is unwrapped alone
BORDER = re.compile(r"[^\x20-\x7e]|[!$()*,<>?@\[\]^`|~]")
#: base64 in one run, or in lines of at least 60 characters; the shortest match of any kind takes 16 characters
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{60,}(?:\r?\n[A-Za-z0-9+/_-]{60,})*(?:\r?\n[A-Za-z0-9+/_-]+)?|[A-Za-z0-9+/_-]{16,}")
PRINTABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
# bytes that may stand in a hex match or a base64 run become x: a search for a row of x finds such runs
HEX_RUNS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
BASE64_RUNS = bytes(120 if c < 128 and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))
PIECE = 1 << 20  # bytes of decompressed text that are scanned at once
STREAM = 1 << 26  # bytes of a compressed stream inside another one
OPENERS = {
    b"\x1f\x8b": lambda: zlib.decompressobj(31),
    **{b"\x78" + level: zlib.decompressobj for level in (b"\x01", b"\x5e", b"\x9c", b"\xda")},
    b"BZh": bz2.BZ2Decompressor,
    b"\xfd7zXZ\x00": lzma.LZMADecompressor,
}
ZSTD = b"\x28\xb5\x2f\xfd"


@dataclass(frozen=True)
class Layer:
    """Text, or a compressed stream, and the source range of each unit; one range if all have the same, none in the document."""

    body: str | bytes
    starts: np.ndarray | int | None = None
    ends: np.ndarray | int | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.starts, np.ndarray):
            return int(self.starts[a:b].min()), int(self.ends[a:b].max())
        return (a, b) if self.starts is None else (self.starts, self.ends)

    def ranges(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(self.starts, np.ndarray):
            return self.starts[a:b], self.ends[a:b]
        return (np.arange(a, b), np.arange(a + 1, b + 1)) if self.starts is None else (np.full(b - a, self.starts), np.full(b - a, self.ends))

    def digest(self) -> bytes:
        body = self.body if isinstance(self.body, bytes) else self.body.encode("utf-8", "surrogatepass")
        whole = not isinstance(self.starts, np.ndarray)
        place = f"{self.starts}:{self.ends}".encode() if whole else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.blake2b(hashlib.blake2b(body, digest_size=16).digest() + place, digest_size=16).digest()


def compressed(data: bytes) -> bool:
    return data.startswith((*OPENERS, ZSTD))


def base_matches(text: str, raw: bytes | None = None) -> Iterator[tuple[int, int, int]]:
    """Start, kind and end of every base match; cheap searches of the bytes decide which patterns need to run."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        yield from ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"])
    if b"AKIA" in raw:
        yield from ((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"])
    if b"x" * LEAST["hex"] in raw.translate(HEX_RUNS):
        yield from ((m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"])


def _character(m: re.Match) -> int | None:
    """Code point of an escape other than a percent escape; None if there is no such character."""
    code = int(m["dec"]) if m["dec"] else int(m["u4"] or m["ub"] or m["u8"] or m["x"] or m["hx"], 16)
    return code if 0 < code < 0x110000 else None


def _decoded(run: list[re.Match]) -> Iterator[tuple[str, re.Match, re.Match]]:
    """Characters of percent escapes in a row, read as UTF-8, with the first and last escape of each."""
    data, k = bytes(int(m["pct"], 16) for m in run), 0
    while k < len(data):
        size = {0xC: 2, 0xD: 2, 0xE: 3, 0xF: 4}.get(data[k] >> 4, 1)
        try:
            char = data[k : k + size].decode()
        except UnicodeDecodeError:
            char, size = run[k][0], 1  # no character: the escape stays
        yield char, run[k], run[min(k + size, len(run)) - 1]
        k += size


def _unescaped(layer: Layer, a: int, b: int) -> Iterator[Layer]:
    """The segment a to b with one layer of escapes replaced, and what compressed streams its percent escapes spell."""
    text, (own, own_ends) = layer.body[a:b], layer.ranges(a, b)
    pieces, starts, ends, at, hit = [], [], [], 0, False

    def copy(first: int, last: int) -> None:
        pieces.append(text[first:last])
        starts.append(own[first:last])
        ends.append(own_ends[first:last])

    def put(char: str, first: re.Match, last: re.Match) -> None:
        pieces.append(char)
        starts.append(np.full(len(char), own[first.start() : last.end()].min()))
        ends.append(np.full(len(char), own_ends[first.start() : last.end()].max()))

    matches, i = list(ESCAPE.finditer(text)), 0
    while i < len(matches):
        m, j = matches[i], i + 1
        copy(at, m.start())
        joined = lambda j: j < len(matches) and matches[j].start() == matches[j - 1].end()
        if m["pct"]:
            while joined(j) and matches[j]["pct"]:
                j += 1
            run = matches[i:j]
            data = bytes(int(x["pct"], 16) for x in run)
            if compressed(data):
                start, end = own[m.start() : run[-1].end()].min(), own_ends[m.start() : run[-1].end()].max()
                yield Layer(data, int(start), int(end))
            for char, first, last in _decoded(run):
                if char == first[0]:
                    copy(first.start(), first.end())
                else:
                    put(char, first, last)
                    hit = True
        else:
            code = _character(m)
            second = _character(matches[j]) if joined(j) and not matches[j]["pct"] else None
            if code and second and 0xD800 <= code < 0xDC00 <= second < 0xE000:
                put(chr(0x10000 + ((code - 0xD800) << 10) + second - 0xDC00), m, matches[j])
                hit, j = True, j + 1
            elif code and not 0xD800 <= code < 0xE000:
                put(chr(code), m, m)
                hit = True
            else:
                copy(m.start(), m.end())
        at, i = matches[j - 1].end(), j
    if hit:
        copy(at, len(text))
        yield Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends))


def _escaped(layer: Layer) -> Iterator[Layer]:
    """What lies below every segment between borders that has an escape."""
    text, done = layer.body, 0
    for m in ESCAPE.finditer(text):
        if m.start() < done:
            continue
        border = BORDER.search(text, m.end())
        stop = border.start() if border else len(text)
        head = m.start()
        while head > done and not BORDER.match(text[head - 1]):
            head -= 1
        yield from _unescaped(layer, head, stop)
        done = stop


def _base64(layer: Layer) -> Iterator[Layer]:
    """What the bytes of every base64 run hold at each of its four alignments."""
    for m in BASE64.finditer(layer.body):
        own, own_ends = layer.ranges(m.start(), m.end())
        codes = np.frombuffer(m[0].encode(), np.uint8)
        kept = np.flatnonzero((codes != 10) & (codes != 13))
        run = codes[kept].tobytes()
        for shift in range(4):
            piece = run[shift : len(run) - ((len(run) - shift) % 4 == 1)]
            data = base64.b64decode(piece + b"=" * (-len(piece) % 4), altchars=b"-_" if b"-" in piece or b"_" in piece else None)
            bits = 8 * np.arange(len(data))
            yield from _bytes(data, own[kept[shift + bits // 6]], own_ends[kept[shift + (bits + 7) // 6]])


def _bytes(data: bytes, starts: np.ndarray | int, ends: np.ndarray | int) -> Iterator[Layer]:
    """What bytes hold: a compressed stream, or printable stretches of text."""
    if compressed(data):
        yield Layer(data, starts, ends) if isinstance(starts, int) else Layer(data, int(starts.min()), int(ends.max()))
    for m in PRINTABLE.finditer(data):
        text = m[0].decode("utf-8", "replace")
        if isinstance(starts, int):
            yield Layer(text, starts, ends)
            continue
        lead = np.flatnonzero((np.frombuffer(m[0], np.uint8) & 0xC0) != 0x80)
        if len(lead) == len(text):
            last = np.append(lead[1:], len(m[0])) - 1
            yield Layer(text, starts[m.start() + lead], ends[m.start() + last])


def _opened(layer: Layer) -> Iterator[Layer]:
    """What a compressed stream holds, in pieces that end at a border; all of it comes from the range of the stream."""
    stream, rest = _inflated(layer.body), b""
    for out in stream:
        rest += out
        if compressed(rest):  # a stream in a stream is opened as a whole
            while len(rest) < STREAM and (more := next(stream, b"")):
                rest += more
            break
        if len(rest) >= PIECE:
            cut = max(rest.rfind(mark) for mark in (b"\n", b",", b"<", b">", b"(", b")")) + 1 or len(rest)
            yield from _bytes(rest[:cut], layer.starts, layer.ends)
            rest = rest[cut:]
    yield from _bytes(rest, layer.starts, layer.ends)


def _inflated(data: bytes) -> Iterator[bytes]:
    """Decompressed pieces of at most PIECE bytes, as far as the stream is sound; streams may follow one another."""
    try:
        if data.startswith(ZSTD):
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data, read_across_frames=True) as reader:
                while out := reader.read(PIECE):
                    yield out
        while make := next((make for mark, make in OPENERS.items() if data.startswith(mark)), None):
            opener, feed = make(), data
            while not opener.eof:
                out = opener.decompress(feed, PIECE)
                feed = getattr(opener, "unconsumed_tail", b"")
                if not out and not opener.eof:
                    return
                yield out
            data = opener.unused_data
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


def layers_below(layer: Layer) -> Iterator[Layer]:
    """All layers one step below: of a stream its content, of a text its escapes and base64 runs unwrapped."""
    if isinstance(layer.body, bytes):
        yield from _opened(layer)
    else:
        yield from _escaped(layer)
        yield from _base64(layer)


def scan(text: str, raw: bytes | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both sorted by start, kind, end), and how many layers lay below the text.

    The worklist ends when no layer gives one that was not there before with
    the same content and source.
    """
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    base = sorted(base_matches(text, raw))
    if not (b"%" in raw or b"\\" in raw or b"&" in raw or b"x" * 16 in raw.translate(BASE64_RUNS)):
        return base, base, 0
    found, seen, work = set(base), set(), [Layer(text)]
    while work:
        for below in layers_below(work.pop()):
            if len(below.body) and (key := below.digest()) not in seen:
                seen.add(key)
                work.append(below)
                if isinstance(below.body, str):
                    for a, kind, b in base_matches(below.body):
                        start, end = below.source(a, b)
                        found.add((start, kind, end))
    return base, sorted(found), len(seen)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document, in its text and in every layer below it.

    Returns one row per row of ``docs``: doc_id, ``found`` (array of start,
    kind as place in KINDS, end, base; sorted by these) and ``layers``, the number
    of layers that were unwrapped. Positions are code points, ends exclusive; a
    secret of a deeper layer has the range of the characters it came from. Null
    and empty texts have no secrets; repeated rows are separate; no rows give no
    rows; other columns are ignored. There is no shuffle, and a task holds one
    batch and the layers of one document. Compressed streams are scanned in pieces
    of about a megabyte, cut at a character that no match contains; only a run of
    more than that without such a character is cut elsewhere.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("found", SPANS), T.StructField("layers", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, layers = [], []
            for raw in batch.column("raw"):
                raw = raw.as_py() or b""
                base, spans, below = scan(raw.decode("utf-8", "replace"), raw)
                known = set(base)
                found.append([{"start": a, "kind": k, "end": b, "base": (a, k, b) in known} for a, k, b in spans])
                layers.append(below)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(layers, pa.int64())], names=["doc_id", "found", "layers"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, schema)


def spans_text(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
