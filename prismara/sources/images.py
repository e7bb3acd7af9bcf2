"""Images as rows: size and format from a file's head, grey samples where a decoder is installed."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import hashing, media

try:
    from PIL import Image
except ImportError:  # sizes and formats need no decoder
    Image = None

#: Samples of a difference hash: columns and rows.
POINTS = (9, 8)


def _jpeg(head: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def size_of(content: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a PNG, GIF, BMP, JPEG or WebP file; None for others and broken ones."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", content[16:24])
        if content[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", content[6:10])
        if content[:2] == b"BM":
            width, height = struct.unpack("<ii", content[18:26])
            return "bmp", width, abs(height)
        if content[:2] == b"\xff\xd8" and (found := _jpeg(content)):
            return "jpeg", *found
        if content[:4] == b"RIFF" and content[8:16] == b"WEBPVP8X":
            return "webp", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
    except (struct.error, IndexError):
        return None
    return None


def samples(content: bytes) -> tuple[bytes, int, int] | None:
    """(grey samples by row, columns, rows) at the points of the image itself that a difference hash looks at, whatever its
    size; None without a decoder or for what it can't read."""
    if Image is None:
        return None
    try:
        picture = Image.open(io.BytesIO(content)).convert("L")
        (width, height), (across, down) = picture.size, POINTS
        found = [picture.getpixel((x * (width - 1) // (across - 1), y * (height - 1) // (down - 1))) for y in range(down) for x in range(across)]
    except Exception:  # what a decoder can't read has no samples
        return None
    return bytes(found), across, down


def decode(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """keep, width, height, format, orientation and phash of image files; all null for what can't be read."""
    schema = StructType([*df.select(*keep).schema, *StructType.fromDDL("format string, width int, height int, gray array<int>, gw int, gh int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [size_of(x) if x else None for x in batch.column(content).to_pylist()]
            grays = [samples(x) if h else None for x, h in zip(batch.column(content).to_pylist(), heads, strict=True)]
            columns = [pa.array([h and h[i] for h in heads], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            columns += [pa.array([g and list(g[0]) for g in grays], pa.list_(pa.int32())), *(pa.array([g and g[i] for g in grays], pa.int32()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, "format", "width", "height", "gray", "gw", "gh"])

    found = df.select(*keep, content).mapInArrow(run, schema)
    return found.select(*keep, "format", "width", "height", media.orientation(F.col("width"), F.col("height")).alias("orientation"), F.when(F.col("gray").isNotNull(), hashing.difference_hash(F.col("gray"), F.col("gw"), F.col("gh"))).alias("phash"))
