"""Media columns: texts kept as progressive JPEG images and read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import jpeg
from termloom.llm.common import small_batches
from termloom.session import spread

UNIT = 576


def padded(text: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``UNIT``."""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (size - len(text))


def to_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, images``: each text's padded bytes as an array of progressive JPEG files.

    Null text: empty, hence one image of padding. Null and repeated ids keep their
    rows; equal texts give equal images; extra columns are ignored. Longer payloads
    than one image holds take several.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, raw), pa.int64()), pa.array([jpeg.store(padded(r)) for r in raw], pa.list_(pa.binary()))], names=["id", "n_bytes", "images"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, images array<binary>")
    return out.withColumnRenamed("id", id_col)


def decoded(image: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(samples, None) of a progressive JPEG file, or (None, what is wrong with it)."""
    if image is None:
        return None, None
    try:
        return jpeg.to_rgb(jpeg.read_frame(image)), None
    except Exception as e:  # noqa: BLE001  foreign bytes can break a decoder anywhere
        return None, f"no readable progressive JPEG: {e}"


def rgb_tensors(images: DataFrame, image_col: str = "image") -> DataFrame:
    """Decode a column of progressive JPEG files: all columns of ``images`` and ``height``,
    ``width``, ``rgb`` (full-resolution samples, row by row) and ``error``, which replace
    columns of those names. A null image gives nulls; so does a file that cannot be read,
    with the reason in ``error``."""
    images = images.drop("height", "width", "rgb", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                rgb = [decoded(x) for x in part.column(image_col).to_pylist()]
                sizes = [pa.array([r.shape[k] if r is not None else None for r, _ in rgb], pa.int32()) for k in (0, 1)]
                add = [*sizes, pa.array([r.tobytes() if r is not None else None for r, _ in rgb], pa.binary()), pa.array([e for _, e in rgb], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *add], names=[*part.schema.names, "height", "width", "rgb", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)
    return images.mapInArrow(run, f"{kinds}, height int, width int, rgb binary, error string")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read images (as ``to_images`` stores them) back: sizes, checksums and a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for images in batch.column("images").to_pylist():
                payload, feature = jpeg.describe(images)
                media = b"".join(images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *cols], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(stored.dtypes)[id_col]
    table = stored.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", "images")
    out = table.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


def op9_media(spark, sf_dir: str) -> DataFrame:
    return media_features(to_images(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
