"""Kind and dimensions of image bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_kind(data: Column) -> Column:
    """``jpeg``, ``png`` or ``bmp`` by the first bytes; null for others."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("FFD8"), "jpeg").when(head == "89504E470D0A1A0A", "png").when(head.startswith("424D"), "bmp")


def dimensions(data: bytes) -> tuple[int, int]:
    """Width and height from the headers; (-1, -1) where they can't be told."""
    if data[:2] == b"BM" and len(data) >= 26:
        return tuple(int.from_bytes(data[k : k + 4], "little", signed=True) for k in (18, 22))  # a height below 0: rows from the top
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return -1, -1


@F.arrow_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def image_size(data: pa.Array) -> pa.Array:
    found = [dimensions(x) if x is not None else (-1, -1) for x in data.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], ["width", "height"])
