"""Media columns: types found by signature, not by what was declared.

An Aho-Corasick automaton over the magic bytes of known formats finds every
place in the content where one could begin; a validator for the format then
walks its structure (sizes, chunks, checksums) and gives the length, or rejects
the place.  A file that begins the content gives the detected type; others,
further in, are carved out.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# ---- formats: each validator gets the bytes and the start, and gives the length of a sound file there, or 0


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return 0
        seen.add(kind)
        p += 8 + n + (n & 1)
    return end - at if {b"fmt ", b"data"} <= seen and p >= end else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if first and kind != b"IHDR" or p + 12 + n > len(b) or binascii.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        first, p = False, p + 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:  # entropy-coded data runs to the next marker that is no restart
            p += 2 + struct.unpack_from(">H", b, p + 2)[0]
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
            if b[p + 1 : p + 2] == b"\xd9":
                return p + 2 - at
        else:
            p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30 or b[at + 6 : at + 10] != b"\0\0\0\0":
        return 0
    n, offset, header = struct.unpack_from("<I", b, at + 2)[0], *struct.unpack_from("<II", b, at + 10)
    return n if header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= n <= len(b) - at else 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


def _zip(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 4] == b"PK\x03\x04" and p + 30 <= len(b):
        flags, packed, name, extra = struct.unpack_from("<H", b, p + 6)[0], struct.unpack_from("<I", b, p + 18)[0], *struct.unpack_from("<HH", b, p + 26)
        if flags & 8:  # sizes follow the data; only the directory tells
            p = b.find(b"PK\x01\x02", p)
            break
        p += 30 + name + extra + packed
    while p >= 0 and b[p : p + 4] == b"PK\x01\x02" and p + 46 <= len(b):
        p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
    return p + 22 + struct.unpack_from("<H", b, p + 20)[0] - at if p > at and b[p : p + 4] == b"PK\x05\x06" and p + 22 <= len(b) else 0


def _flac(b: bytes, at: int) -> int:
    p, last = at + 4, False
    if b[p : p + 4][1:] != b"\0\0\x22" or b[p] & 0x7F:
        return 0
    while not last and p + 4 <= len(b):
        last, p = bool(b[p] & 0x80), p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    return len(b) - at if last and p <= len(b) else 0  # frames carry no total length


def _mp4(b: bytes, at: int) -> int:
    p, boxes = at, 0
    while p + 8 <= len(b):
        n = struct.unpack_from(">I", b, p)[0]
        if n < 8 or p + n > len(b) or not b[p + 4 : p + 8].isalnum():
            break
        p, boxes = p + n, boxes + 1
    return p - at if boxes >= 2 else 0


#: Type, magic bytes, offset of the magic within a file, validator.
FORMATS = (
    ("audio/wav", b"RIFF", 0, _wav),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF8", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("audio/flac", b"fLaC", 0, _flac),
    ("video/mp4", b"ftyp", 4, _mp4),
)
UNKNOWN = "application/octet-stream"


def automaton() -> ahocorasick.Automaton:
    """Bytes are looked up as the characters of their Latin-1 decoding."""
    a = ahocorasick.Automaton()
    for k, (_, magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(content: bytes | None, found: ahocorasick.Automaton) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """Detected type (null for null content), its length, and (type, offset, length) of each file carved from within.

    Places inside a file that was accepted as carved are not looked at again;
    those inside the outermost file, which begins the content, are.
    """
    if content is None:
        return None, 0, []
    kind, size, carved, free = UNKNOWN, 0, [], 0
    for last, k in found.iter(content.decode("latin-1")):
        name, magic, offset, valid = FORMATS[k]
        at = last + 1 - len(magic) - offset
        if at < free and at or at < 0:
            continue
        n = valid(content, at)
        if n and at == 0:
            kind, size = name, n
        elif n:
            carved.append((name, at, n))
            free = at + n
    return kind, size, carved


SNIFFED = "media_type string, media_length long, mislabelled boolean, carved array<struct<type:string,offset:long,length:long>>"


def sniff_media(df: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """``df`` with media_type, media_length, mislabelled and carved (which replace columns of those names).

    media_type is the type whose magic bytes and structure begin the content,
    else octet-stream; null content has null type and nothing carved.
    mislabelled: the declared type is not that one (null without a
    declaration).  Empty content is octet-stream.  One row out for each row in.
    """

    @F.pandas_udf(SNIFFED)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        found = automaton()
        for contents, said in batches:
            rows = []
            for b, d in zip(contents, said, strict=True):
                kind, size, carved = sniff(None if b is None else bytes(b), found)
                rows.append((kind, size, None if d is None or kind is None else d != kind, [{"type": t, "offset": o, "length": n} for t, o, n in carved]))
            yield pd.DataFrame(rows, columns=["media_type", "media_length", "mislabelled", "carved"])

    found = apply(F.col(content), F.col(declared).cast("string") if declared else F.lit(None).cast("string"))
    return df.withColumn("_sniffed", found).withColumns({n: F.col(f"_sniffed.{n}") for n in ("media_type", "media_length", "mislabelled", "carved")}).drop("_sniffed")


# ---- texts stored as media and read back

PAD = 64
#: Samples a second that the stored sound declares.
RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono PCM samples, byte for byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(stored: bytes) -> bytes:
    """The samples of a stored sound, by walking its chunks."""
    p = 12
    while stored[p : p + 4] != b"data":
        p += 8 + struct.unpack_from("<I", stored, p + 4)[0]
    return stored[p + 8 : p + 8 + struct.unpack_from("<I", stored, p + 4)[0]]


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
STORED_ARROW = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
#: Bytes of a stored sound before its samples.
HEADER = 44


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) as a sound of 8-bit samples, sniffed and read back.

    The payload is the text's UTF-8 bytes (null: none) with zeros up to a
    positive multiple of 64.  feature has what sniffing makes of the stored
    bytes, declared as octet-stream: the corrected type, its length, what was
    carved from within, then number, mean and root mean square of the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                raw = b"" if text is None else text.encode("utf-8")
                stored = to_wav(raw + b"\0" * (PAD * max(1, -(-len(raw) // PAD)) - len(raw)))
                kind, size, carved = sniff(stored, found)
                if kind != "audio/wav" or size != len(stored):
                    raise ValueError(f"a stored text is not read back as a whole sound: {kind}, {size} of {len(stored)} bytes")
                payload = from_wav(stored)
                x = np.frombuffer(payload, np.uint8).astype(np.int64)
                embedded = "+".join(f"{t}@{o - HEADER}:{n}" for t, o, n in carved) or "none"
                feature = f"{UNKNOWN}>{kind};bytes={size};carved={embedded};samples={len(x)};mean={x.sum() / len(x):.6f};rms={np.sqrt((x * x).sum() / len(x)):.6f}"
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STORED_ARROW, strict=True)] if rows else [pa.array([], t) for t in STORED_ARROW]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), STORED)
