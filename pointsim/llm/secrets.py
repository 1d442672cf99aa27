"""Secret scans through nested encodings.

A worklist per document: the text is the first layer. Each layer is scanned by the three kinds of pattern, and unwrapped:
percent escapes, Unicode escapes (\\uXXXX, also in pairs, \\UXXXXXXXX, \\xXX, &#N;) and runs of base64 whose bytes are text, or
gzip, zlib, bz2 or xz data, give new layers, until none is new. A layer whose text was seen at the same place of the
document is not taken again, which ends cycles; equal texts at several places are a layer each. Every character of a layer maps
to the characters of the document that it came from, and so does every secret found in it.

A run of base64 is decoded once in each of its four alignments. Values that start and end at the run's ends or at /, _ or -
come first, the longest first; then stretches of text in what they leave, of ``least_text`` bytes or more, wherever they start.
Neighbouring lines of base64 are unwrapped joined, and each line alone as well. Quote marks or comment signs before the lines are
not passed over. Bytes that aren't text end a stretch, and don't spoil what is around them: so do bad bytes in percent escapes.

Defined results: a null or empty text has no secrets; repeated rows are scanned alike, each on its own; an empty table gives no
rows; texts of any length are scanned whole, at a cost in proportion to it; of extra columns none is read. Compressed data that
unpacks to more than ``most_unpacked`` bytes is scanned in pieces, cut at ends of lines where no value goes on; where there is no
such place a piece ends within a run, and ``refused`` counts that.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# fixed values: the patterns of the three kinds and their least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ of 16 or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
LINE_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+")
SEPARATOR = re.compile(r"[/_-]")
BASE64_BYTES = np.zeros(256, bool)
BASE64_BYTES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
#: Text of several characters; bytes that aren't text are surrogates.
GOOD = re.compile("[^\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd\ud800-\udfff]+")
BAD_BYTE = re.compile("[\udc80-\udcff]")
#: Ends of lines after which no run of base64 goes on, and any place between words.
CUT, LOOSE_CUT = re.compile(rb"[^A-Za-z0-9+/_ \t\r\n-][ \t\r]*\n"), re.compile(rb"[ \t\r\n]")
#: Bytes that are text in UTF-8 without control characters, three characters at least.
STRETCH = re.compile(
    rb"(?:[\t-\r -~]|\xc2[\xa0-\xbf]|[\xc3-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xef[\x80-\xbe][\x80-\xbf]|\xef\xbf[\x80-\xbc\xbe\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){3,}"
)
#: How gzip, bz2, xz and zlib data start.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x20\x3f\x5e\x7d\x9c\xbb\xda\xf9]")
URL_SAFE = str.maketrans("-_", "+/")


@dataclass(frozen=True)
class Rules:
    least_run: int = 16  # characters of a base64 run
    least_text: int = 12  # bytes of a stretch of text within a run
    most_unpacked: int = 16_000_000  # bytes of compressed data that are in memory at a time


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets in one layer."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


# ---------------------------------------------------------------- layers
class Layer:
    """A text and, for each of its characters, the first and last + 1 character of the document it came from."""

    def __init__(self, text: str, first: np.ndarray, last: np.ndarray, how: str):
        self.text, self.first, self.last, self.how = text, first, last, how

    def place(self) -> tuple[bytes, int, int]:
        """A digest of its text, and where it stands in the document."""
        own = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return own, *((int(self.first[0]), int(self.last[-1])) if self.text else (0, 0))

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start:end].min()), int(self.last[start:end].max())


def _rewritten(layer: Layer, pattern: re.Pattern, decode, how: str) -> Layer | None:
    """The layer with all matches decoded in place, characters around them as they are. decode: text and, for each of its
    characters, the first and last + 1 character of the layer."""
    parts, first, last, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        decoded = decode(m)
        if decoded is None:
            continue
        text, lo, hi = decoded
        parts += [layer.text[at : m.start()], text]
        first += [layer.first[at : m.start()], layer.first[lo]]
        last += [layer.last[at : m.start()], layer.last[hi - 1]]
        at = m.end()
    if not parts:
        return None
    parts.append(layer.text[at:])
    first.append(layer.first[at:])
    last.append(layer.last[at:])
    return Layer("".join(parts), np.concatenate(first), np.concatenate(last), how)


def read_text(data: bytes) -> tuple[str, np.ndarray]:
    """Bytes as text, with a surrogate for each byte that isn't, and the byte where each character starts (and the end)."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return text, np.arange(len(data) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return text, np.concatenate([[0], np.cumsum(size)])


def _percent(m: re.Match) -> tuple[str, np.ndarray, np.ndarray] | None:
    text, at = read_text(bytes.fromhex(m[0].replace("%", "")))
    lo, hi = m.start() + 3 * at[:-1], m.start() + 3 * at[1:]
    if not BAD_BYTE.search(text):
        return text, lo, hi
    bad = np.array([0xDC80 <= ord(c) <= 0xDCFF for c in text])
    if bad.all():
        return None
    spelled_out = "".join([m[0][3 * a : 3 * a + 3] if x else c for c, a, x in zip(text, at, bad, strict=False)])
    times = np.where(bad, 3, 1)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)  # 0, 1, 2 within an escape that stays
    stays = np.repeat(bad, times)
    lo = np.repeat(lo, times) + step
    return spelled_out, lo, np.where(stays, lo + 1, np.repeat(hi, times))


def _unicode(m: re.Match) -> tuple[str, np.ndarray, np.ndarray] | None:
    if m[1]:
        code = 0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00
    else:
        code = int(m[7]) if m[7] else int(m[3] or m[4] or m[5] or m[6], 16)
    if 0xD800 <= code <= 0xDFFF or code >= 0x110000:
        return None
    return chr(code), np.array([m.start()]), np.array([m.end()])


# ---------------------------------------------------------------- base64 and compressed data
def _opened(data: bytes | memoryview):
    """What unpacks data that starts with one of the magic numbers."""
    head = bytes(data[:6])
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh" and b"1" <= head[3:4] <= b"9":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    return None


def _unpacked(opened, data: bytes | memoryview, step: int):
    """The content, ``step`` bytes at a time; EOFError if the data ends before it does."""
    while True:
        out = opened.decompress(data, step)
        data = getattr(opened, "unconsumed_tail", b"")
        yield out
        if opened.eof:
            return
        if not out and not data:
            raise EOFError


BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)


@dataclass
class Packed:
    """Compressed data at the start of ``data``: how many bytes it has, and its content if that is small."""

    data: bytes
    size: int
    content: bytes | None

    @classmethod
    def at(cls, data: bytes, rules: Rules) -> Packed | None:
        opened = _opened(data)
        if opened is None:
            return None
        kept, n = [], 0
        try:
            for piece in _unpacked(opened, data, 1 << 20):
                n += len(piece)
                kept = [*kept, piece] if n <= rules.most_unpacked else []
        except BROKEN:
            return None
        size = len(data) - len(opened.unused_data)
        return cls(bytes(data[:size]), size, b"".join(kept) if n <= rules.most_unpacked else None)

    def pieces(self, rules: Rules):
        """(bytes, whether a run goes on after them), in order; together all of the content."""
        if self.content is not None:
            yield self.content, False
            return
        held = b""
        for piece in _unpacked(_opened(self.data), self.data, max(rules.most_unpacked // 2, 1)):
            held += piece
            if len(held) < rules.most_unpacked:
                continue
            ends = [m.end() for m in CUT.finditer(held)] or [m.end() for m in LOOSE_CUT.finditer(held)]
            cut = ends[-1] if ends else len(held)
            yield held[:cut], not ends
            held = held[cut:]
        if held:
            yield held, False


def stretches(data: bytes, least: int) -> list[tuple[str, int, int]]:
    """Text in data of ``least`` bytes or more: text, from, to. All of it, where it is text throughout."""
    text, at = read_text(data)
    if (m := GOOD.fullmatch(text)) is not None:
        return [(text, 0, len(data))]
    return [(m[0], int(at[m.start()]), int(at[m.end()])) for m in GOOD.finditer(text) if at[m.end()] - at[m.start()] >= least]


class Alignment:
    """Bytes of a run of base64 read from its character ``shift`` on, and the stretches of text in them."""

    def __init__(self, run: str, shift: int, rules: Rules):
        body = run[shift:].translate(URL_SAFE)
        if len(body) % 4 == 1:
            body = body[:-1]
        self.shift, self.data = shift, base64.b64decode(body + "=" * (-len(body) % 4))
        self.spans = [m.span() for m in STRETCH.finditer(self.data) if m.end() - m.start() >= rules.least_text]

    def char(self, byte: int) -> int:
        """The first character of the run that a byte comes from."""
        return self.shift + byte // 3 * 4 + byte % 3

    def value(self, lo: int, hi: int, end: int) -> tuple[str, np.ndarray, np.ndarray]:
        """The text of bytes lo to hi and, for each character, the first and last + 1 character of the run, ``end`` at most."""
        text, at = read_text(self.data[lo:hi].decode("utf-8", "ignore").encode())  # without a character that the end cuts
        return text, self.shift + (lo + at[:-1]) // 3 * 4, np.minimum(self.shift - (-(lo + at[1:]) // 3) * 4, end)


class Free:
    """Places of a run that no decoded value has taken."""

    def __init__(self):
        self.starts, self.ends = [], []

    def has(self, a: int, b: int) -> bool:
        k = bisect_left(self.ends, a + 1)
        return k == len(self.starts) or self.starts[k] >= b

    def take(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def values(run: str, rules: Rules) -> list[tuple[int, int, object]]:
    """Values in a run that don't overlap: from, to, and text with its places (text, first, last) or Packed."""
    n = len(run)
    cuts = [m.start() for m in SEPARATOR.finditer(run)]
    starts, ends = [0, *(k + 1 for k in cuts)], [*cuts, n]
    begins, found, rest = set(starts), [], []
    read = [Alignment(run, shift, rules) for shift in range(4 if n > rules.least_run else 1)]
    for own in read:
        packed_from = set()
        for m in MAGIC.finditer(own.data):
            at = own.char(m.start())
            if at in begins and m.start() % 3 == 0:
                if packed := Packed.at(memoryview(own.data)[m.start() :], rules):
                    found.append((at, min(at - (-packed.size * 4 // 3), n), packed))
                    packed_from.add(at)
            elif m[0][0] != 0x78 and (packed := Packed.at(memoryview(own.data)[m.start() :], rules)):
                rest.append((at, min(own.char(m.start() + packed.size - 1) + 2, n), packed))
        for lo, hi in own.spans:
            rest.append((own.char(lo), min(own.char(hi - 1) + 2, n), (own, lo, hi)))
            for k in range(bisect_left(starts, own.char(lo)), bisect_left(starts, own.char(hi))):
                a = starts[k]
                byte = (a - own.shift) // 4 * 3
                if a % 4 != own.shift or a in packed_from or own.data[byte] & 0xC0 == 0x80:
                    continue
                j = bisect_right(ends, a + (4 * (hi - byte) + 3) // 3) - 1
                while j >= 0 and (ends[j] - a) % 4 == 1:
                    j -= 1
                if j >= 0 and ends[j] - a >= rules.least_run:
                    found.append((a, ends[j], (own, byte, byte + (ends[j] - a) * 3 // 4)))
    free, out = Free(), []
    for part in (found, rest):  # text and data that start anywhere come last
        for a, b, what in sorted(part, key=lambda x: (x[0] - x[1], x[0])):
            if free.has(a, b):
                free.take(a, b)
                out.append((a, b, what if isinstance(what, Packed) else what[0].value(what[1], what[2], b)))
    return out


def whole(run: str, rules: Rules) -> tuple[int, object] | None:
    """How many characters of a run the value takes that starts it, and the value: compressed data, or text to the run's end."""
    own = Alignment(run, 0, rules)
    if packed := Packed.at(own.data, rules):
        return min(-(-packed.size * 4 // 3), len(run)), packed
    if len(run) % 4 != 1 and own.spans == [(0, len(own.data))]:
        return len(run), own.value(0, len(own.data), len(run))
    return None


class Reader:
    """Unwraps the runs of one document; what a run holds is kept, for its copies."""

    def __init__(self, rules: Rules):
        self.rules, self.refused, self.known = rules, 0, {}

    def layers(self, layer: Layer, at, found) -> Iterator[Layer]:
        """Layers of a value: text, or the pieces of compressed data. at: where characters of its run stand in the layer."""
        if not isinstance(found[2], Packed):
            text, lo, hi = found[2]
            if text:
                yield Layer(text, layer.first[at(lo)], layer.last[at(hi - 1)], "base64")
            return
        a, b, packed = found
        cut = False
        for piece, goes_on in packed.pieces(self.rules):
            cut |= goes_on
            for text, _, _ in stretches(piece, self.rules.least_text):
                yield Layer(text, np.broadcast_to(layer.first[at(a)], len(text)), np.broadcast_to(layer.last[at(b - 1)], len(text)), "packed")
        self.refused += cut

    def held(self, how, run: str):
        key = how.__name__, run
        if key in self.known:
            return self.known[key]
        got = how(run, self.rules)
        if len(run) < 1 << 20:
            self.known[key] = got
        return got

    def lines(self, layer: Layer) -> Iterator[Layer]:
        """Values that run over several lines."""
        for m in WRAPPED.finditer(layer.text):
            edges = [m.start(), *(k for p in LINE_BREAK.finditer(layer.text, m.start(), m.end()) for k in p.span()), m.end()]
            lines = list(zip(edges[::2], edges[1::2], strict=True))
            free = Free()
            for i, j in _blocks(lines):
                if not free.has(i, j):
                    continue
                got = self.held(whole, "".join([layer.text[a:b] for a, b in lines[i:j]]))
                if got:
                    size = np.cumsum([b - a for a, b in lines[i:j]])
                    free.take(i, i + int(np.searchsorted(size, got[0])) + 1)
                    at = np.concatenate([np.arange(a, b) for a, b in lines[i:j]])
                    yield from self.layers(layer, at.__getitem__, (0, got[0], got[1]))

    def below(self, layer: Layer) -> Iterator[Layer]:
        """The layers that a layer holds."""
        yield from self.lines(layer)
        for m in BASE64.finditer(layer.text):
            for found in self.held(values, m[0]):
                yield from self.layers(layer, lambda k, a=m.start(): a + k, found)
        if "%" in layer.text and (x := _rewritten(layer, PERCENT, _percent, "url")):
            yield x
        if ("\\" in layer.text or "&#" in layer.text) and (x := _rewritten(layer, UNICODE, _unicode, "unicode")):
            yield x


def _blocks(lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of lines that may be one wrapped value, the longest first: all, all but the first or last, and lines of one width
    with the shorter one that ends them, or without it."""
    n = len(lines)
    found = {(0, n), (0, n - 1), (1, n), (1, n - 1)}
    width = [b - a for a, b in lines]
    i = 0
    while i < n:
        j = i + 1
        while j < n and width[j] == width[i]:
            j += 1
        found.add((i, j))
        if j < n and width[j] < width[i]:
            found.add((i, j + 1))
            if i:  # a first line that shares its line with other text
                found.add((i - 1, j + 1))
        if i:
            found.add((i - 1, j))
        i = j
    return sorted((f for f in found if f[1] - f[0] > 1), key=lambda f: (f[0] - f[1], f[0]))


def layers(text: str, rules: Rules):
    """The layers below a text, each once for each place; last the number of refused ones. Of each level one layer is held."""
    at = np.arange(len(text), dtype=np.int32)
    root, reader = Layer(text, at, at + 1, "text"), Reader(rules)
    seen, work = {root.place()}, [reader.below(root)]
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
        elif x.place() not in seen:
            seen.add(x.place())
            yield x
            work.append(reader.below(x))
    yield reader.refused


def nested(text: str, rules: Rules = Rules()) -> tuple[list[tuple[int, int, int]], int, int]:
    """Secrets of the layers below, as spans of the text; number of layers; refused ones."""
    found, n, refused, scans = [], 0, 0, {}
    for layer in layers(text, rules):
        if isinstance(layer, int):
            refused = layer
            continue
        n += 1
        own = layer.place()[0]
        if own not in scans:
            scans[own] = scan(layer.text)
        for start, kind, end in scans[own]:
            a, b = layer.span(start, end)
            found.append((a, kind, b))
    return found, n, refused


# ---------------------------------------------------------------- documents
def wrapped_rows(raw: np.ndarray, offsets: np.ndarray, rules: Rules) -> np.ndarray:
    """Texts that may hold something to unwrap: an escape, or a long run of the characters of base64."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    hexes = np.zeros(256, bool)
    hexes[[*b"0123456789abcdefABCDEF"]] = True
    if len(raw) > 2:
        escape = (raw[:-2] == 37) & hexes[raw[1:-1]] & hexes[raw[2:]]
        escape |= (raw[:-2] == 92) & ((raw[1:-1] == 117) | (raw[1:-1] == 85) | (raw[1:-1] == 120)) & hexes[raw[2:]]
        escape |= (raw[:-2] == 38) & (raw[1:-1] == 35)
        out[np.searchsorted(offsets, np.flatnonzero(escape), "right") - 1] = True
    starts, ends = C.spans(BASE64_BYTES[raw])
    out[np.searchsorted(offsets, starts[ends - starts >= rules.least_run], "right") - 1] = True
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: counts and digest of the secrets in plain sight, all spans, those of nested layers, layers, refused."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("nested", pa.string()), ("n_layers", pa.int64()), ("refused", pa.int64())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for i, j in C.pieces(column):
                deep = wrapped_rows(*C.utf8(column[i:j]), rules)
                out = []
                for k, text in enumerate(column[i:j].to_pylist()):
                    base = sorted(scan(text)) if text else []
                    more, n, refused = nested(text, rules) if deep[k] else ((), 0, 0)
                    if not base and not more:
                        out.append((0, 0, 0, nothing, "", "", n, refused))
                        continue
                    kinds = [x[1] for x in base]
                    more = sorted(set(more).difference(base))
                    out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(sorted([*base, *more])), spelled(more), n, refused))
                yield C.record(schema, [ids[i:j], *(list(c) for c in zip(*out, strict=True))])

    columns = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, nested string, n_layers long, refused long"
    return C.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, columns)
