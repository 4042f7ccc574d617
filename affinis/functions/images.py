"""Images: headers, dimensions, perceptual hashes and gating of recognised text."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE_TYPE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def kind(content: Column) -> Column:
    """png, jpeg or webp by the first bytes of a binary column; null for anything else or fewer than 12 bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(F.length(content) < 12, None).when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp")


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from a PNG, JPEG or WebP header; None where there is none."""
    if data is None or len(data) < 24:
        return None
    if data[:4] == b"\x89PNG":
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp_size(data)
    return _jpeg_size(data) if data[:2] == b"\xff\xd8" else None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 8 < len(data):
        if data[at] != 0xFF:
            at += 1
        elif data[at + 1] in (0xC0, 0xC1, 0xC2):
            high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
            return wide, high
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _webp_size(data: bytes) -> tuple[int, int] | None:
    form = data[12:16]
    if form == b"VP8 " and len(data) >= 30:
        wide, high = struct.unpack("<HH", data[26:30])
        return wide & 0x3FFF, high & 0x3FFF
    if form == b"VP8L" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if form == b"VP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    return None


@F.pandas_udf(SIZE_TYPE)
def dimensions(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(None if c is None else bytes(c)) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def _half(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; 64 where either is null, no hex, or of another length."""
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))
    return F.when(F.coalesce(good, F.lit(False)), bits).otherwise(64)


def distance_similarity(distance: Column) -> Column:
    """1 at distance 0, falling by a thirty-second for each bit, 0 from 32 on."""
    return F.when(distance <= 0, 1.0).when(distance >= 32, 0.0).otherwise(F.floor((1 - distance / 32.0) * 10000 + 0.5) / 10000.0)


def wants_recognition(source: Column, width: Column, height: Column) -> Column:
    """Images large enough for text recognition: 120 x 40 in PDF files, 100 x 40 in others."""
    return F.coalesce((height >= 40) & (width >= F.when(source == ".pdf", 120).otherwise(100)), F.lit(False))


def adds_text(recognised: Column, known: Column) -> Column:
    """Recognised text is added when longer than 15 characters and its first 30 are not in the known text."""
    return F.coalesce((F.length(recognised) > 15) & ~F.contains(F.coalesce(known, F.lit("")), F.substring(recognised, 1, 30)), F.lit(False))


def number(h: Column) -> Column:
    """The 64 bits of a 16-digit hex hash as a signed number; null where it is null, no hex, or of another length."""
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(_half(h, 1), 32).bitwiseOR(_half(h, 9)))


def keyed(images: Column) -> Column:
    """ARRAY<STRUCT<imageId, sha, bits>> of an array of STRUCT<imageId, sha256, dhash>, as best_of takes it: hashes are read
    once an image, not once a pair."""
    return F.transform(images, lambda x: F.struct(x.imageId.alias("imageId"), F.lower(x.sha256).alias("sha"), number(x.dhash).alias("bits")))


def similarity(x: Column, y: Column) -> Column:
    """Of two images as `keyed` gives them: 1 for equal bytes, else what the distance of the perceptual hashes gives, 64
    where either has none."""
    distance = F.coalesce(F.bit_count(x.bits.bitwiseXOR(y.bits)), F.lit(64))
    return F.when(F.coalesce(x.sha == y.sha, F.lit(False)), 1.0).otherwise(distance_similarity(distance))


def matches(images_a: Column, images_b: Column, least: float = 0.50) -> Column:
    """ARRAY<STRUCT<imageAId, imageBId, similarity>> of two arrays as `keyed` gives them: pairs at `least` or above."""
    pairs = F.flatten(F.transform(images_a, lambda x: F.transform(images_b, lambda y: F.struct(x.imageId.alias("imageAId"), y.imageId.alias("imageBId"), similarity(x, y).alias("similarity")))))
    return F.filter(pairs, lambda p: p.similarity >= least)


def best_of(matched: Column) -> Column:
    """The highest similarity among matches, 0 without any."""
    return F.coalesce(F.array_max(F.transform(matched, lambda p: p.similarity)), F.lit(0.0))
