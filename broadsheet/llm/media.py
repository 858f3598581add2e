"""Media columns: signature sniffing, validation and carving (operator 8).

`store` keeps a text as samples of a media file, without loss: its UTF-8 bytes, padded with bytes 255 to a positive
multiple of UNIT, are the 8-bit grey samples of a PNG image, UNIT to a row. `sniff` looks at any binary column: one
Aho-Corasick automaton finds the magic bytes of all formats in one pass, the validator of each format then confirms
structure and length at that place, and what is left is the type at byte 0 (whatever was declared) and the media
embedded further on, with their ranges. `payload` reads the samples back from the stored bytes.

Validators read headers, walk chunks or tables and check the lengths and checksums that a format states; magic bytes
that no validator confirms count for nothing. Embedded media inside a confirmed one are not reported again.

Null or empty text: one unit of bytes 255. Null media: no type, nothing carved. Equal texts give equal values in all
columns. Bytes of any length, each row on its own. Empty table: no rows. Columns of the input stay, whatever their names,
but for those that an operator adds. Everything happens where the row lies; no shuffle.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aside, back

UNIT = 576
PAD = b"\xff"
PNG = b"\x89PNG\r\n\x1a\n"
UNKNOWN = "application/octet-stream"


# ---- validators: (bytes, place of the magic) -> end of the media, or None if the structure does not hold


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(memoryview(b)[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end if n == 0 and not first else None
        p, first = end, False
    return None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p = at + 12
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    return end if p in (end, end + 1) and p > at + 12 else None


def _gif(b: bytes, at: int) -> int | None:
    def blocks(p: int) -> int | None:
        while p < len(b):
            if b[p] == 0:
                return p + 1
            p += 1 + b[p]
        return None

    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    images = 0
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 if images else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            images += 1
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, scans = at + 2, 0
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 if scans else None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0x00, 0xFF, 0xD8):
            return None
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data run to the next marker that is not a restart or an escape
            scans += 1
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 if scans and b[p : p + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    ok = zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size
    return at + size if ok and at + size <= len(b) else None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    other = b.find(b"%PDF-", at + 5)  # updates are appended, so the last mark before another document counts
    end = b.rfind(b"%%EOF", at, other if other >= 0 else len(b))
    return end + 5 if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def _zip(b: bytes, at: int) -> int | None:
    p, files = at, 0
    while p + 30 <= len(b) and b[p : p + 4] == b"PK\x03\x04":
        flags, name, extra = (struct.unpack_from("<H", b, p + k)[0] for k in (6, 26, 28))
        if flags & 8:  # the length stands behind the data: only the directory tells
            return _zip_by_directory(b, at)
        p, files = p + 30 + struct.unpack_from("<I", b, p + 18)[0] + name + extra, files + 1
    while p + 46 <= len(b) and b[p : p + 4] == b"PK\x01\x02":
        p += 46 + sum(struct.unpack_from("<3H", b, p + 28))
    if files and p + 22 <= len(b) and b[p : p + 4] == b"PK\x05\x06":
        end = p + 22 + struct.unpack_from("<H", b, p + 20)[0]
        return end if end <= len(b) and struct.unpack_from("<H", b, p + 10)[0] == files else None
    return None


def _zip_by_directory(b: bytes, at: int) -> int | None:
    """The end of an archive whose directory says that it began here."""
    p = b.find(b"PK\x05\x06", at)
    while 0 <= p <= len(b) - 22:
        size, offset, comment = struct.unpack_from("<IIH", b, p + 12)
        begins = p - size
        if begins - offset == at and b[begins : begins + 4] == b"PK\x01\x02" and p + 22 + comment <= len(b):
            return p + 22 + comment
        p = b.find(b"PK\x05\x06", p + 4)
    return None


def _gzip(b: bytes, at: int) -> int | None:
    d = zlib.decompressobj(31)
    try:
        view, p = memoryview(b), at
        while p < len(b) and not d.eof:
            d.decompress(view[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data) if d.eof else None


def _flac(b: bytes, at: int) -> int | None:
    p, first = at + 4, True
    while p + 4 <= len(b):
        head, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (head & 0x7F or n != 34):
            return None
        p, first = p + 4 + n, False
        if head & 0x80:
            return len(b) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        last = b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if last:
            return p
    return None


#: Magic bytes, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (PNG, "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "riff", _riff),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
)
ENDLESS = ("audio/flac",)
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, check in FORMATS:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    found.make_automaton()
    return found


def media_in(b: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the confirmed media in b, by start, none inside another.

    Media of an ENDLESS type do not tell their length: they reach to the next confirmed one or to the end.
    """
    out, reached = [], 0
    for last, (n, kind, check) in _automaton().iter(b.decode("latin-1")):
        at = last + 1 - n
        if at < reached:
            continue
        end = check(b, at)
        if end is not None:
            out.append((RIFF_TYPES[b[at + 8 : at + 12]] if kind == "riff" else kind, at, end))
            reached = at + n if kind in ENDLESS else end
    following = [at for _, at, _ in out[1:]] + [len(b)]
    return [(kind, at, min(end, after) if kind in ENDLESS else end) for (kind, at, end), after in zip(out, following, strict=False)]


# ---- samples


def as_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image whose samples are the payload, a multiple of UNIT, UNIT samples to a row."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + payload[i : i + UNIT] for i in range(0, len(payload), UNIT))
    head = struct.pack(">IIBBBBB", UNIT, len(payload) // UNIT, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def from_png(b: bytes) -> bytes:
    """The samples of an image that as_png wrote."""
    p, data, width, height = 8, [], 0, 0
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, woven = struct.unpack_from(">IIBBBBB", b, p + 8)
            if (depth, colour, woven) != (8, 0, 0):
                raise ValueError("only plain 8-bit grey images hold payloads")
        elif kind == b"IDAT":
            data.append(b[p + 8 : p + 8 + n])
        p += 12 + n
    rows = zlib.decompress(b"".join(data))
    if len(rows) != (width + 1) * height or any(rows[:: width + 1]):
        raise ValueError("rows must be whole and unfiltered")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % UNIT or (0 if text else UNIT))


# ---- columns


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes (of the text) and media, the stored form."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([as_png(padded(t or b"")) for t in batch], dtype=object)

    raw = F.coalesce(F.col("_text").cast("binary"), F.lit(b""))
    rows = aside(docs, F.col(f"`{text}`").alias("_text"))
    return back(rows, docs, n_bytes=F.octet_length(raw).cast("long"), media=stored(raw))


def payload(media: str | Column = "media") -> Column:
    """The payload that stored bytes hold; null for null."""

    @F.pandas_udf("binary")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if b is None else from_png(b) for b in batch], dtype=object)

    return read(media)


def sniff(media: str | Column = "media", declared: str | Column | None = None) -> Column:
    """Struct: type (that of the bytes, else the declared one, else UNKNOWN), corrected, length (of the media at 0), embedded."""

    @F.pandas_udf("type string, corrected boolean, length long, embedded array<struct<type:string,start:long,end:long>>")
    def sniffed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, said in batches:
            rows = []
            for b, stated in zip(blobs, said, strict=True):
                if b is None:
                    rows.append((None, False, None, []))
                    continue
                found = media_in(b)
                head = found[0] if found and found[0][1] == 0 else None
                kind = head[0] if head else stated or UNKNOWN
                inside = [{"type": k, "start": s, "end": e} for k, s, e in found[bool(head) :]]
                rows.append((kind, bool(head) and kind != stated, head[2] if head else None, inside))
            out = pd.DataFrame(rows, columns=["type", "corrected", "length", "embedded"])
            yield out.astype({"type": object, "length": "Int64"})

    said = F.lit(None).cast("string") if declared is None else declared
    return sniffed(media, said)


def carve(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each embedded piece of media: the columns of df, then carved_type and carved, its bytes."""
    rows = aside(df, F.col(f"`{media}`").alias("_media")).withColumn("_sniffed", sniff("_media"))
    found = rows.withColumn("_piece", F.explode("_sniffed.embedded"))
    length = (F.col("_piece.end") - F.col("_piece.start")).cast("int")
    piece = F.substring(F.col("_media"), (F.col("_piece.start") + 1).cast("int"), length)
    return back(found, df, carved_type=F.col("_piece.type"), carved=piece)
