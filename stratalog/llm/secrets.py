"""Secret scans over every encoding layer of a text.

A worklist, depth first, starts with the text itself. Each layer is scanned, then unwrapped: URL escapes, Unicode
escapes and character references each give the layer again with those sequences decoded, as far as it is changed (cut at plain
words, over which nothing goes); every stretch
of readable text that a base64 run holds at any alignment, plainly or in a gzip, zlib or Zstandard stream,
gives a layer of its own. Streams are read over all their members, in windows. A run is taken by itself and joined over line ends, also escaped ones. New layers go on the worklist until none is left. A layer of the same content and spans as one
seen before is not entered again, nor one of the content of a layer that it came from, which ends cycles (a stream
that unpacks to itself, for one); equal content that stands elsewhere is a layer of its own.
Every layer keeps, for each of its characters, the span of the original text that it came from.
"""

from __future__ import annotations

import binascii
import hashlib
import html
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import text_or_empty

KINDS = ("assign", "access", "hex")
MIN_VALUE = 6
#: Unpacked streams are scanned in windows of this many bytes, whatever their length, which bounds memory against bombs.
WINDOW = 8 << 20
OVERLAP = 1 << 20
#: Compressed bytes read at a time, and decompressed at a time.
CHUNK, STEP = 1 << 16, 256
#: Length of the shortest base match (12 characters) in base64.
MIN_BASE64 = 16

_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# As leftmost matches of AKIA[A-Z0-9]+ and [0-9a-f]+ with the short ones dropped.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_BASE64)
#: A line end, also an escaped one, with what indents the next line.
_LINE_END = r"(?:\r\n?|\n|\\r\\n|\\[rn])[ \t]*"
_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*{_LINE_END}[A-Za-z0-9+/_-]++)+")
_ENDS = re.compile(rf"[ \t]*{_LINE_END}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")
#: What a run over line ends is made of.
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n \t\\"
#: UTF-8 without control characters, as many characters as a base match has at least.
_READABLE = re.compile(
    rb"(?:[\x09-\x0d\x20-\x7e]|\xc2[\xa0-\xbf]|[\xc3-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}+"
)
#: A plain word between spaces, before another: a place that no match, run or escape goes over, whatever is decoded beside it.
_CUT = re.compile(r"(?<=\x20)[A-Za-z0-9]{2,}+\x20(?=[A-Za-z0-9])")
_URLSAFE = str.maketrans("-_", "+/")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, code points, end exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _rewritten(text: str, starts: np.ndarray | None, ends: np.ndarray | None, pattern: re.Pattern, decode) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The pieces of a layer that hold matches, with these decoded; decode gives pairs of a character and how many source characters it took.

    A piece without a match is as it was in the layer, where it has been scanned: no match, escape or run goes over a cut.
    """
    decoded = [(m, got) for m in pattern.finditer(text) if (got := decode(m[0])) is not None]
    if not decoded:
        return []
    cuts, pieces = [0, *(m.end() for m in _CUT.finditer(text)), len(text)], []
    for i, matches in itertools.groupby(decoded, lambda d: bisect_right(cuts, d[0].start())):
        low, high = cuts[i - 1], cuts[i]
        first = np.arange(low, high, dtype=np.int32) if starts is None else starts[low:high]
        last = first + 1 if ends is None else ends[low:high]
        parts, s, e, at = [], [], [], low
        for m, got in matches:
            pos = m.start()
            parts.append(text[at:pos])
            s.append(first[at - low : pos - low])
            e.append(last[at - low : pos - low])
            for char, taken in got:
                parts.append(char)
                s.append(np.full(len(char), first[pos - low]))
                e.append(np.full(len(char), last[pos - low + taken - 1]))
                pos += taken
            at = pos
        pieces.append(("".join([*parts, text[at:high]]), np.concatenate([*s, first[at - low :]]), np.concatenate([*e, last[at - low :]])))
    return pieces


def _url(run: str) -> list[tuple[str, int]] | None:
    raw = bytes.fromhex(run.replace("%", ""))
    out, i, changed = [], 0, False
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + n].decode(), 3 * n))
                changed, i = True, i + n
                break
            except UnicodeDecodeError:
                continue
        else:
            out += [(c, 1) for c in run[3 * i : 3 * i + 3]]
            i += 1
    return out if changed else None


def _unicode(run: str) -> list[tuple[str, int]] | None:
    if run[0] == "&":
        char = html.unescape(run)
    else:
        code = int(run[2:].strip("{}"), 16)
        char = chr(code) if code < 0x110000 else run
    if 0xD800 <= ord(char[0]) < 0xE000 or char == run:
        return None
    return [(char, len(run))]


class _Stream:
    """The members of a compressed stream, or frames, one after the other, as an iterator of pieces of their content.

    When it is exhausted, ``used`` bytes were read, ``ended`` tells whether the last member was whole, and ``failed``
    whether it was found to be none.
    """

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.used, self.ended, self.failed = chunks, 0, True, False

    def __iter__(self) -> Iterator[bytes]:
        d, rest, at, whole, empty = None, b"", 0, 0, True
        for chunk in itertools.chain(self.chunks, (None,)):
            rest, at = rest[at:] + (chunk or b""), 0
            while at < len(rest):
                if d is None:
                    pad = at
                    while whole and pad < len(rest) and not rest[pad]:  # gzip files may be padded
                        pad += 1
                    if len(rest) - pad < 4 and chunk is not None:
                        break
                    head = rest[pad : pad + 4]
                    if (d := _decoder(head, whole > 0)) is None:
                        return
                    self.used, at, self.ended, empty = self.used + pad - at, pad, False, True
                piece = rest[at : at + STEP]
                try:
                    out = d.decompress(piece)
                except (zlib.error, zstandard.ZstdError):
                    self.failed = True
                    break
                left = len(d.unused_data) if d.eof else 0
                at, self.used, empty = at + len(piece) - left, self.used + len(piece) - left, empty and not out
                if d.eof:
                    d, self.ended, whole = None, True, self.used
                if out:
                    yield out
            if self.failed:
                break
        if whole and not self.ended and empty and _is_zlib(head):  # two bytes that look like a further member
            self.used, self.ended, self.failed = whole, True, False


def _decoder(head: bytes, later: bool):
    if head[:4] == b"\x28\xb5\x2f\xfd" or later and head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:  # or a frame to skip
        return zstandard.ZstdDecompressor().decompressobj()
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    return zlib.decompressobj() if _is_zlib(head) else None


def _level(raw: bytes, depth: int) -> _Stream:
    """What comes out when raw is unpacked ``depth`` times."""
    stream = _Stream(raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))
    for _ in range(depth - 1):
        stream = _Stream(stream)
    return stream


def _windows(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content in windows that overlap by ``OVERLAP`` and by the base64 run that the window breaks off, if it is no longer than a window."""
    held, size, need = [], 0, WINDOW
    added = False
    for piece in pieces:
        held.append(piece)
        size, added = size + len(piece), True
        if size >= need:
            whole = b"".join(held)
            yield whole
            run = len(whole) - len(whole.rstrip(_RUN_BYTES))
            tail = whole[-max(OVERLAP, run if run <= WINDOW else 0) :]
            held, size, added = [tail], len(tail), False
            need = size + WINDOW
    if added:
        yield b"".join(held)


def _is_zlib(raw: bytes) -> bool:
    return raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] << 8 | raw[1]) % 31 == 0


def _segments(raw: bytes) -> Iterator[tuple[int, str]]:
    """Each stretch of readable UTF-8 long enough for a base match, and where it starts."""
    for m in _READABLE.finditer(raw):
        yield m.start(), m[0].decode()


def _from_base64(body: str, lines: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray, str, bool]]:
    """Texts that a base64 run holds at any of its four alignments, and for each character the range of the run it came from.

    Compressed streams are not looked for in the lines of a run that goes on over line ends.
    """
    body = body.translate(_URLSAFE)
    for shift in range(4):
        part = body[shift:]
        if len(part) % 4 == 1:
            part = part[:-1]
        if len(part) < MIN_BASE64:
            return
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        for at, text in _segments(raw):
            ends = at + np.cumsum([len(c.encode()) for c in text])
            starts = np.r_[at, ends[:-1]]
            yield text, shift + starts * 8 // 6, shift + np.minimum(-(-ends * 8 // 6), len(part)), "base64", False
        done = 0
        for m in () if lines else _MAGIC.finditer(raw):
            if m.start() >= done:
                done = yield from _from_stream(raw, m.start(), shift, len(body))


def _from_stream(raw: bytes, at: int, shift: int, size: int) -> Generator[tuple[str, np.ndarray, np.ndarray, str, bool], None, int]:
    """Texts of the innermost content of a stream, which all come from the whole of it. Returns where a whole stream ends."""
    start, raw = at, raw[at:]
    depths, depth, ended, sure, done = [], 0, True, True, 0
    seen, head, key = set(), raw[:4], hashlib.blake2b(raw, digest_size=16).digest()
    while key not in seen and _decoder(head, False) is not None:
        seen.add(key)
        stream, digest, first = _level(raw, depth + 1), hashlib.blake2b(digest_size=16), b""
        for piece in stream:
            digest.update(piece)
            first = first if len(first) > 3 else (first + piece)[:4]
        if not depth:
            size = min(size, shift - (start + stream.used) * 8 // -6)
            done = start + stream.used if stream.ended else 0
            # Two bytes are no proof of a zlib stream inside a run: one that breaks off counts if it holds readable text.
            sure = not _is_zlib(head) or start == shift == 0 and not stream.failed
        elif not stream.ended:
            depths.append(depth)  # perhaps only looks like a stream within the stream
            if not first:
                break
        depth, ended, key, head = depth + 1, ended and stream.ended, digest.digest(), first
    if not depth:
        return 0
    cut, place = not ended, shift + start * 8 // 6
    for depth in sorted({*depths, depth}):
        for window in _windows(_level(raw, depth)):
            for _, text in _segments(window):
                yield text, np.broadcast_to(place, len(text)), np.broadcast_to(size, len(text)), "base64" + ">unpack" * depth, cut
                cut = False
    if cut and sure:
        yield "", np.empty(0, np.int64), np.empty(0, np.int64), "base64>unpack", True
    return done


def _runs(layer: str) -> Iterator[tuple[np.ndarray, str, bool]]:
    """Base64 runs: the place of each character, the characters, and whether it is a line of a longer run."""
    covered = []
    for m in _LINES.finditer(layer):
        mask = np.ones(m.end() - m.start(), bool)
        # An escaped line end has a letter of the alphabet in it, so the line ends are matched, not the other characters.
        for j in _ENDS.finditer(m[0]):
            mask[j.start() : j.end()] = False
        at = np.flatnonzero(mask)
        if len(at) >= MIN_BASE64:
            yield m.start() + at, _ENDS.sub("", m[0]), False
            covered.append((m.start(), m.end()))
    i = 0
    for m in _BASE64.finditer(layer):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        yield np.arange(m.start(), m.end()), m[0], i < len(covered) and covered[i][0] <= m.start()


def _inner(layer: str, starts: np.ndarray | None, ends: np.ndarray | None) -> Iterator[tuple[str, np.ndarray, np.ndarray, str, bool]]:
    """The layers inside a layer, with their spans and names, and whether a stream was not read to its end."""
    for at, body, lines in _runs(layer):
        for inner, s, e, name, cut in _from_base64(body, lines):
            size = len(inner)
            if whole := size > 0 and s.strides == (0,):
                s, e = s[:1], e[:1]
            s, e = at[s], at[e - 1]
            s, e = (s, e + 1) if starts is None else (starts[s], ends[e])
            yield inner, *((np.broadcast_to(s, size), np.broadcast_to(e, size)) if whole else (s, e)), name, cut
    kinds = [k for k in _ESCAPES if any(c in layer for c in k[0]) and k[2].search(layer)]
    while kinds:
        _, name, pattern, decode = kinds.pop(0)
        pieces = _rewritten(layer, starts, ends, pattern, decode)[::-1]
        if not kinds:  # a chain of escapes may be very long: its layers are not all held
            layer = starts = ends = at = s = e = None
        while pieces:
            yield *pieces.pop(), name, False


#: Marks, name, pattern and decoder of what rewrites a layer.
_ESCAPES = (("%", "url", _URL, _url), ("\\&", "unicode", _UNICODE, _unicode))
_REWRITES = {name for _, name, *_ in _ESCAPES}


def scan(text: str) -> tuple[list[Span], list[Span], list[str], int]:
    """Base spans; those that deeper layers add; the distinct chains of the layers entered, as in ``url*3>base64``; how many streams
    were not read to their end."""
    base = base_spans(text)
    found, added = set(base), []
    seen: set[tuple[bytes, bytes]] = set()
    chains: dict[str, None] = {}
    cuts = 0
    # The layers on the way to the present one: their keys, and which layers they have still to give.
    path, work = [_key(text)], [(("", "", 0), _inner(text, None, None))]
    while work:
        (before, last, times), layers = work[-1]
        if (got := next(layers, None)) is None:
            path.pop()
            work.pop()
            continue
        layer, starts, ends, name, cut = got
        cuts += cut
        # Escapes only shorten: what ends cycles are the layers of base64 runs.
        key, escapes = _key(layer), name in _REWRITES
        if not layer or not escapes and key in path or (place := (key, _place(starts, ends))) in seen:
            continue
        seen.add(place)
        chain = (before, last, times + 1) if name == last else (f"{_chain(before, last, times)}>".lstrip(">"), name, 1)
        chains[_chain(*chain)] = None
        for kind, a, b in base_spans(layer):
            span = (kind, int(starts[a]), int(ends[b - 1]))
            if span not in found:
                found.add(span)
                added.append(span)
        path.append(None if escapes else key)
        work.append((chain, _inner(layer, starts, ends)))
    return base, added, list(chains), cuts


def _chain(before: str, last: str, times: int) -> str:
    return f"{before}{last}*{times}" if times > 1 else before + last


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _place(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Digest of a layer's spans."""
    if starts[0] == starts[-1] and ends[0] == ends[-1]:  # they ascend
        starts, ends = starts[:1], ends[:1]
    return hashlib.blake2b(np.r_[starts, ends].astype("<i8").tobytes(), digest_size=16).digest()


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_spans, spans, layers, cut_layers.

    base_spans are those of the text itself, spans adds what deeper layers hold, mapped to the original
    text, each as kind:start:end. layers are the distinct chains of decodings, cut_layers how many streams were not read to
    their end, a stream once for each layer that it is met in. Null and empty texts have none. Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added, chains, cuts = scan(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, spelled(base), spelled(base + added), ",".join(chains), cuts))
            names = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "layers", "cut_layers"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, layers string, cut_layers bigint"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
