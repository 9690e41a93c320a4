import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from kinforge.llm import media, queries


def png(extra=b""):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0" + extra)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2D\1\0;"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 2) + b"12\xff\x003\xff\xd0" + b"\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


FILES = {
    "image/png": png(),
    "image/gif": gif(),
    "image/jpeg": jpeg(),
    "image/bmp": bmp(),
    "audio/wav": media.to_wav(b"abc"),
    "image/webp": b"RIFF" + struct.pack("<I", 14) + b"WEBPVP8 " + struct.pack("<I", 2) + b"xx",
    "audio/flac": b"fLaC\x80" + (34).to_bytes(3, "big") + bytes(34),
    "audio/ogg": b"OggS\0\4" + bytes(20) + b"\1\3abc",
    "video/mp4": struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 8) + b"moov",
    "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
    "application/zip": zipped(),
    "application/gzip": gzip.compress(b"text" * 50, mtime=0),
}


@pytest.mark.parametrize("kind", FILES)
def test_whole_file(kind):
    found, _ = media.sniff(FILES[kind])
    assert (kind, 0, len(FILES[kind])) in found


@pytest.mark.parametrize("kind", [k for k in FILES if k != "audio/flac"])
def test_carving(kind):
    blob = b"junk BM GIF8" + FILES[kind] + b" tail"
    found, _ = media.sniff(blob)
    assert found == [(kind, 12, len(FILES[kind]))]


@pytest.mark.parametrize("kind", [k for k in FILES if k not in ("audio/flac", "application/pdf")])
def test_cut_files_are_rejected(kind):
    found, seen = media.sniff(FILES[kind][:-1])
    assert not any(k == kind for k, _, _ in found) and seen > 0


def test_damaged_checksum():
    bad = bytearray(png())
    bad[20] ^= 1
    assert media.sniff(bytes(bad))[0] == []


@pytest.mark.parametrize(
    "part, tail",
    [(b"%PDF-1 ", b""), (b"%PDF-1 ", b"%%EOF"), (b"PK\3\4", b""), (b"PK\3\4", b"PK\5\6" + bytes(18)), (b"OggS\0\0" + bytes(21), b""), (b"GIF89a\1\1\1\1\0\0\0!\1\1", b"x" * 400)]
    + [(struct.pack(">I", 8) + b"ftyp", b""), (b"\xff\xd8\xff\xe0\0\2", b""), (b"\xff\xd8\xff\xda\0\2", b""), (b"fLaC\0\0\0\x22", b"")],
    ids=["pdf", "pdf end", "zip", "zip end", "ogg", "gif", "mp4", "jpeg", "jpeg scan", "flac"],
)
def test_hostile_blobs_take_linear_time(part, tail):
    blob = part * (1_000_000 // len(part)) + tail
    began = time.perf_counter()
    found, seen = media.sniff(blob)
    assert time.perf_counter() - began < 15 and seen >= 1_000_000 // len(part) - 1


def test_walks_that_share_places_do_not_mislead():
    """Good files behind failed ones, and inside them."""
    for kind, blob in FILES.items():
        if kind in ("audio/flac", "application/pdf"):
            continue
        found, _ = media.sniff(blob[:-1] + b"...." + blob)
        assert (kind, len(blob) + 3, len(blob)) in found


def test_embedded_media_are_carved_from_a_stored_payload():
    blob = media.to_wav(b"text " + png() + b" more " + gif())
    kind, corrected, inner, payload, n, feature = media._inspected(blob, media.UNKNOWN)
    assert kind == "audio/wav" and corrected and [x["type"] for x in inner] == ["image/png", "image/gif"]
    for x in inner:
        assert blob[x["place"] : x["place"] + x["length"]] in (png(), gif())
    assert payload[:n] == b"text " + png() + b" more " + gif() and "embedded=image/png,image/gif" in feature


def digest(text):
    raw = (text or "").encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_query(spark, sf, doc_rows):
    got = {r["doc_id"]: r for r in queries.op4_signature_sniffing(spark, sf).collect()}
    for doc_id, text in doc_rows:
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == digest(text)
        blob = media.to_wav((text or "").encode())
        assert r["media_bytes"] == len(blob) and r["media_sha256"] == hashlib.sha256(blob).hexdigest()
    assert len(got) == len(doc_rows)


def test_odd_rows(spark, odd, odd_rows):
    rows = media.inspect(media.store(odd)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in rows) == sorted((i or -1, len((t or "").encode())) for i, t in odd_rows)
    assert all(r["type"] == "audio/wav" for r in rows)
    assert media.inspect(media.store(odd.limit(0))).count() == 0
    blobs = spark.createDataFrame([(1, None, None), (2, b"", "image/png"), (3, png(), "image/gif"), (4, png(), "image/png")], "doc_id long, media binary, declared string")
    got = {r["doc_id"]: (r["type"], r["corrected"]) for r in media.inspect(blobs).collect()}
    assert got == {1: (None, None), 2: ("image/png", False), 3: ("image/png", True), 4: ("image/png", False)}
