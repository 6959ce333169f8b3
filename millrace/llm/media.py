"""Media columns: texts as progressive JPEG pictures, and pictures as RGB tensors.

``stored`` puts the UTF-8 bytes of each text, filled up with bytes 255 to a
positive multiple of ``UNIT``, into the coefficients of a picture.  ``tensors``
decodes pictures and stores the payload and the full-resolution RGB tensor as
columns beside them, and ``described`` digests those columns and computes features
of the tensors.  All work row by row, without a shuffle; a picture takes memory
in proportion to its own text, and rows go on in slices of few.

Null and empty texts have the payload of one filled unit.  Equal texts have equal
pictures, tensors and features.  Repeated rows are handled alike, null ids stay
null.  A null picture has a null tensor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, stateless, text_bytes
from millrace.llm.jpeg import Decoder, payload_of, write

UNIT = 576


def padded(content: bytes, unit: int = UNIT) -> bytes:
    return content + b"\xff" * (-len(content) % unit or (0 if content else unit))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (the picture)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                contents = text_bytes(part.column(1))
                media = [write(padded(content)) for content in contents]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in contents], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(stateless(run), "doc_id long, n_bytes long, media binary")


TENSORS = "payload binary, height int, width int, rgb binary"


def tensors(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of ``media`` and payload, height, width, rgb (height x width x 3 bytes, row by row)."""
    at = media.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                payloads, heights, widths, pixels = [], [], [], []
                for content in part.column(at).to_pylist():
                    picture = None if content is None else Decoder(content)
                    rgb = None if picture is None else picture.rgb()
                    payloads.append(None if picture is None else payload_of(picture))
                    heights.append(None if rgb is None else rgb.shape[0])
                    widths.append(None if rgb is None else rgb.shape[1])
                    pixels.append(None if rgb is None else rgb.tobytes())
                columns = [pa.array(payloads, pa.binary()), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(pixels, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "payload", "height", "width", "rgb"])

    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in media.schema)
    return media.mapInArrow(stateless(run), f"{kept}, {TENSORS}")


def feature(height: int, width: int, rgb: bytes) -> str:
    """Size, means of the channels in thousandths, and checksum of a tensor."""
    sums = np.frombuffer(rgb, np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    means = ",".join(str(1000 * x // (height * width)) for x in sums)
    return f"{width}x{height} {means} {zlib.crc32(rgb):08x}"


def features(rows: DataFrame) -> DataFrame:
    """``rows`` of ``tensors`` with a feature in place of each tensor."""
    kept = [i for i, name in enumerate(rows.columns) if name not in ("height", "width", "rgb")]
    at = [rows.columns.index(name) for name in ("height", "width", "rgb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                found = [None if x[2] is None else feature(*x) for x in zip(*(part.column(i).to_pylist() for i in at))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(found, pa.string())], [*(part.schema.names[i] for i in kept), "feature"])

    schema = ", ".join(f"`{rows.schema[i].name}` {rows.schema[i].dataType.simpleString()}" for i in kept)
    return rows.mapInArrow(stateless(run), f"{schema}, feature string")


def described(media: DataFrame) -> DataFrame:
    """Payload and picture digests and features of rows of ``stored``."""
    rows = features(tensors(media))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
