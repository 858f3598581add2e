import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from broadsheet.llm import media
from pyspark.sql import functions as F

from .corpus import table, texts


def wav(data: bytes) -> bytes:
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("a.txt"), b"hello")
    return out.getvalue()


BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(9) + b"\x02\x02L\x01\x00\x3b"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
ALL = [
    ("audio/wav", wav(b"abcd")),
    ("application/zip", zipped()),
    ("application/gzip", gzip.compress(b"hello" * 9)),
    ("image/bmp", BMP),
    ("image/gif", GIF),
    ("application/pdf", PDF),
    ("image/png", media.as_png(b"\x01" * media.UNIT)),
]


@pytest.mark.parametrize("kind,b", ALL, ids=[k for k, _ in ALL])
def test_confirmed_where_they_lie(kind, b):
    assert media.media_in(b) == [(kind, 0, len(b))]
    assert media.media_in(b"BM RIFF %PDF- x" + b + b"tail") == [(kind, 15, 15 + len(b))]
    assert media.media_in(b[:-3]) == []


def test_round_trip_and_types(spark):
    given = [*texts(7), "RIFF and GIF89a and PK\x03\x04 in prose", "x" * media.UNIT]
    stored = media.store(table(spark, given))
    got = {r.doc_id: r for r in stored.select("doc_id", "n_bytes", "media", media.payload().alias("p"), media.sniff("media", F.lit("audio/wav")).alias("s")).collect()}
    for i, t in enumerate(given):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (max(1, -(-len(raw) // media.UNIT)) * media.UNIT - len(raw))
        r = got[i]
        assert (r.n_bytes, bytes(r.p)) == (len(raw), pad)
        assert (r.s["type"], r.s["corrected"], r.s["length"], r.s["embedded"]) == ("image/png", True, len(r.media), [])
    same = hashlib.sha256(got[0].media).digest()
    assert same == hashlib.sha256(got[len(texts(7)) - 1].media).digest()


def test_carve_and_nulls(spark):
    blob = b"junk" + wav(b"12") + b"--" + zipped()
    df = spark.createDataFrame([(1, bytearray(blob)), (2, None), (3, bytearray(b""))], "id long, media binary")
    got = sorted((r.id, r.carved_type, bytes(r.carved)) for r in media.carve(df).collect())
    assert got == [(1, "application/zip", zipped()), (1, "audio/wav", wav(b"12"))]
    kinds = {r.id: r.s["type"] for r in df.select("id", media.sniff().alias("s")).collect()}
    assert kinds == {1: media.UNKNOWN, 2: None, 3: media.UNKNOWN}
    assert media.store(df.select("id").withColumn("text", F.lit(None).cast("string")).limit(0)).count() == 0


def test_tail_checksum_is_unsigned():
    assert zlib.crc32(media.padded(b"")[-32:]) >= 0


class Pipe(io.RawIOBase):
    """A sink without places, so that archives state lengths behind the data."""

    def __init__(self):
        self.parts = []

    def writable(self):
        return True

    def write(self, b):
        self.parts.append(bytes(b))
        return len(b)


def test_archives_written_as_streams_and_updated_documents():
    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"hello" * 50)
        z.writestr("b.txt", b"more")
    streamed = b"".join(pipe.parts)
    assert streamed[6] & 8
    updated = PDF + b"\n2 0 obj\nstartxref\n40\n%%EOF"
    flac = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34) + b"\xff\xf8" + b"frames"
    blob = b"ab" + streamed + b"cd" + updated + b"ef" + flac + wav(b"12") + b"tail"
    a, b, c = 2, 4 + len(streamed), 6 + len(streamed) + len(updated)
    w = c + len(flac)
    assert media.media_in(blob) == [
        ("application/zip", a, a + len(streamed)),
        ("application/pdf", b, b + len(updated)),
        ("audio/flac", c, w),
        ("audio/wav", w, w + len(wav(b"12"))),
    ]
