"""Operator 4: media columns by signature sniffing.

An Aho-Corasick automaton over the magic bytes of all formats finds candidate
places in one scan of a blob; the validator of each format then walks the
structure there (chunk and box lengths, checksums, trailers) and gives the true
length or rejects the place.  What begins at byte 0 and spans the blob corrects
the declared type; what lies inside is carved out as embedded media.

Texts are stored as WAV files of unsigned 8-bit samples, one sample a byte.

One pass without a shuffle, one blob in memory at a time beside its batch.  Time
is linear in a blob's length: the walks of one blob share what they have found
to lead nowhere.  (The exceptions are made-up: many PNG or gzip heads before one
long part are each checked to its end, and so are RIFF heads whose declared
lengths all differ.)
Defined cases: a null or empty text is a payload of 64 zero bytes; a null blob
has no type, nothing found and a null payload; repeated rows, ties and null ids
give a row each; a text or blob of any length is one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.frames import cut, two_columns

#: A payload is padded with zero bytes to a positive multiple of this.
BLOCK = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


class _Seek:
    """What the scans of one blob have learned, so that no part is walked twice.

    `find` remembers the last hit of each needle; `walk` the places from which a
    format's chain of parts is known to lead nowhere (where it goes on from a
    place does not hang on where it began)."""

    def __init__(self, blob: bytes):
        self.blob, self.found, self.dead = blob, {}, set()

    def find(self, needle: bytes, at: int) -> int:
        """As bytes.find; linear over a scan whose places only grow."""
        since, hit = self.found.get(needle, (0, -2))
        if hit == -2 or at < since or -1 < hit < at:
            since, hit = at, self.blob.find(needle, at)
            self.found[needle] = since, hit
        return hit

    def walk(self, places: Iterator) -> int:
        """The last value of a chain that yields keys of places and then a length, 0 if it fails."""
        seen, length = [], 0
        for key in places:
            if isinstance(key, int):
                length = key
            elif key in self.dead:
                break
            else:
                seen.append(key)
        if not length:
            self.dead.update(seen)
        return length


# --- validators: (blob, place, seek) -> length of the file that begins there, or 0 ---


def _png(b: bytes, at: int, seek: _Seek) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind, end = b[p + 4 : p + 8], p + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def _gif(b: bytes, at: int, seek: _Seek) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    begin = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def parts() -> Iterator:
        p = begin
        while p < len(b):
            yield "gif", p
            kind = b[p]
            if kind == 0x3B:
                yield p + 1 - at
                return
            if kind == 0x21:
                p += 2
            elif kind == 0x2C and p + 10 <= len(b):
                local = b[p + 9]
                p += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
            else:
                return
            while p < len(b) and b[p]:  # sub-blocks
                yield "gif data", p
                p += 1 + b[p]
            p += 1

    return seek.walk(parts())


def _jpeg(b: bytes, at: int, seek: _Seek) -> int:
    def parts() -> Iterator:
        p, scan = at + 2, False
        while p + 2 <= len(b):
            if scan:  # entropy-coded bytes end at a marker that is neither stuffing nor a restart
                p = seek.find(b"\xff", p)
                if p < 0 or p + 2 > len(b):
                    return
                yield "jpeg data", p
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
            else:
                yield "jpeg", p
            if b[p] != 0xFF:
                return
            kind = b[p + 1]
            if kind == 0xD9:
                yield p + 2 - at if scan else 0
                return
            if kind == 0xFF:
                p += 1
                continue
            if p + 4 > len(b):
                return
            n = int.from_bytes(b[p + 2 : p + 4], "big")
            if n < 2 or kind < 0xC0:
                return
            scan = kind == 0xDA
            p += 2 + n

    return seek.walk(parts())


def _bmp(b: bytes, at: int, seek: _Seek) -> int:
    if at + 26 > len(b):
        return 0
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    good = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size and at + size <= len(b)
    return size if good else 0


def _riff(form: bytes) -> Callable[[bytes, int, _Seek], int]:
    def valid(b: bytes, at: int, seek: _Seek) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        if end > len(b):
            return 0

        def parts() -> Iterator:
            p, kinds = at + 12, set()
            while p + 8 <= end:
                yield form, p, end
                n = int.from_bytes(b[p + 4 : p + 8], "little")
                kinds.add(b[p : p + 4])
                p += 8 + n + (n & 1)
            if p == end and kinds and (form != b"WAVE" or {b"fmt ", b"data"} <= kinds):
                yield end - at

        return seek.walk(parts())

    return valid


def _flac(b: bytes, at: int, seek: _Seek) -> int:
    if at + 8 > len(b) or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return 0

    def parts() -> Iterator:
        p = at + 4
        while p + 4 <= len(b):
            yield "flac", p
            last = b[p] & 0x80
            p += 4 + int.from_bytes(b[p + 1 : p + 4], "big")
            if last:  # frames follow up to the end of the blob
                yield len(b) - at if p <= len(b) else 0
                return

    return seek.walk(parts())


def _ogg(b: bytes, at: int, seek: _Seek) -> int:
    def parts() -> Iterator:
        p = at
        while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
            yield "ogg", p
            n = b[p + 26]
            if p + 27 + n > len(b):
                return
            last = b[p + 5] & 4
            p += 27 + n + sum(b[p + 27 : p + 27 + n])
            if p > len(b):
                return
            if last:
                yield p - at
                return

    return seek.walk(parts())


def _mp4(b: bytes, at: int, seek: _Seek) -> int:
    begin = at - 4  # the magic bytes follow the first box's length

    def parts() -> Iterator:
        p, moov = begin, False
        while 0 <= p and p + 8 <= len(b):
            n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
            if n == 1 and p + 16 <= len(b):
                n = int.from_bytes(b[p + 8 : p + 16], "big")
            if n < 8 or p + n > len(b) or not kind.isalnum():
                break
            if not moov:  # a chain that fails has none from here on
                yield "mp4", p
            moov |= kind == b"moov"
            p += n
        if moov:
            yield p - begin

    return seek.walk(parts())


def _pdf(b: bytes, at: int, seek: _Seek) -> int:
    if not b[at + 5 : at + 6].isdigit():
        return 0
    end = seek.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and 0 <= seek.find(b"startxref", at) <= end - 9 else 0


def _zip(b: bytes, at: int, seek: _Seek) -> int:
    end = seek.find(b"PK\5\6", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    good = at + start + size == end and end + 22 + note <= len(b) and b[at + start : at + start + 4] == b"PK\1\2"
    return end + 22 + note - at if good else 0


def _gzip(b: bytes, at: int, seek: _Seek) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    end = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while len(rest) and not end.eof:  # the content is thrown away piece by piece
            end.decompress(rest, 1 << 20)
            rest = end.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(end.unused_data) if end.eof else 0


#: (type, magic bytes, how far into the file the magic lies, validator); the formats' fixed signatures.
FORMATS = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE")),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP")),
    ("video/avi", b"RIFF", 0, _riff(b"AVI ")),
    ("audio/flac", b"fLaC", 0, _flac),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
)


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by_magic: dict[str, list[int]] = {}
    for k, (_, magic, _, _) in enumerate(FORMATS):
        by_magic.setdefault(magic.decode("latin-1"), []).append(k)
    for magic, ks in by_magic.items():
        found.add_word(magic, (len(magic), ks))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> tuple[list[tuple[str, int, int]], int]:
    """([(type, place, length)] of the files confirmed, places looked at).

    A file inside a confirmed one is listed too (that is what is carved); the
    inside of a carved file is not searched again."""
    out: list[tuple[str, int, int]] = []
    seen, until, seek = 0, 0, _Seek(blob)
    for last, (n, ks) in _automaton().iter(blob.decode("latin-1")):
        place = last + 1 - n
        seen += 1
        for k in ks:
            kind, _, lead, valid = FORMATS[k]
            if place - lead < 0 or (out and place - lead < until):
                continue
            if size := valid(blob, place, seek):
                out.append((kind, place - lead, size))
                if place - lead or size < len(blob):
                    until = max(until, place - lead + size)
                break
    return out, seen


def to_wav(raw: bytes) -> bytes:
    """A WAV file whose 8-bit samples are the bytes, padded; its fact chunk has their number before padding."""
    payload = pad(raw)
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sII4sI", b"RIFF", 48 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"fact", 4, len(raw), b"data", len(payload)
    )
    return head + payload


def from_wav(blob: bytes) -> tuple[bytes, int | None, int, int]:
    """(samples, their number by the fact chunk, rate, bits) of a WAV file."""
    p, end = 12, 8 + int.from_bytes(blob[4:8], "little")
    rate = bits = 0
    fact = None
    while p + 8 <= end:
        n = int.from_bytes(blob[p + 4 : p + 8], "little")
        if blob[p : p + 4] == b"fmt ":
            rate, bits = struct.unpack_from("<I6xH", blob, p + 12)
        if blob[p : p + 4] == b"fact":
            fact = int.from_bytes(blob[p + 8 : p + 12], "little")
        if blob[p : p + 4] == b"data":
            return blob[p + 8 : p + 8 + n], fact, rate, bits
        p += 8 + n + (n & 1)
    return b"", fact, rate, bits


def pad(raw: bytes) -> bytes:
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("declared", T.StringType())])
SNIFFED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("type", T.StringType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField(
            "embedded",
            T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("place", T.LongType()), T.StructField("length", T.LongType())])),
        ),
        T.StructField("payload", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("feature", T.StringType()),
    ]
)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media column: doc_id, media, declared type (unknown, to be sniffed)."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in cut(batch):
                texts = part.column(1).to_pylist()
                media = pa.array([to_wav((t or "").encode()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), media, pa.array([UNKNOWN] * len(texts))], names=STORED.names)

    return two_columns(docs, id_col, text_col).mapInArrow(rows, STORED)


def inspect(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """Sniffed type, whether it corrects the declared one, embedded files, the
    samples read back (WAV) or the blob itself, and a feature string."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in cut(batch):
                out = [_inspected(*x) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array([x[k] for x in out], SNIFFED_ARROW[k]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=SNIFFED.names)

    chosen = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"), F.col(declared_col).alias("declared"))
    return chosen.mapInArrow(rows, SNIFFED)


SNIFFED_ARROW = (
    pa.string(),
    pa.bool_(),
    pa.list_(pa.struct([("type", pa.string()), ("place", pa.int64()), ("length", pa.int64())])),
    pa.binary(),
    pa.int64(),
    pa.string(),
)


def _inspected(blob: bytes | None, declared: str | None) -> tuple:
    if blob is None:
        return None, None, [], None, None, None
    found, seen = sniff(blob)
    whole = next((kind for kind, place, size in found if place == 0 and size == len(blob)), None)
    inner = [{"type": k, "place": p, "length": n} for k, p, n in found if p or n < len(blob)]
    payload, n, more = blob, None, ""
    if whole == "audio/wav":
        payload, n, rate, bits = from_wav(blob)
        samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        level = int(np.abs(samples).sum())
        turns = int(np.count_nonzero(np.diff(np.signbit(samples))))
        more = f" rate={rate} bits={bits} samples={len(samples)} level={level} crossings={turns} silent={int((samples == -128).sum())}"
    kind = whole or declared or UNKNOWN
    feature = f"{kind}{more} places={seen} embedded={','.join(x['type'] for x in inner) or '-'}"
    return kind, kind != declared, inner, payload, len(payload) if n is None else n, feature
