"""Media columns: documents stored as progressive JPEGs, and JPEGs read into full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jpeg
from tidemark.llm.common import materialise, small_batches, table, texts

#: What a Python task gathers before it hands rows on.
BATCH_BYTES = 1 << 24
#: The columns that from_media() adds.
NEW = ("width", "height", "feature", "payload", "rgb", "rgb_sha256")


def _in_parts(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += weigh(r)
        if weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in held], f.type) for j, f in enumerate(schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in held], f.type) for j, f in enumerate(schema)], schema=schema)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a progressive JPEG.

    A null text is empty. Null ids and repeated rows keep their rows; other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((i, len(t), jpeg.store(t + bytes(-len(t) % 64 or (0 if t else 64)))) for i, t in zip(b.column(0).to_pylist(), texts(b), strict=True))
            yield from _in_parts(rows, schema, lambda r: len(r[2]))

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def feature_of(image: jpeg.Image) -> tuple[str, str]:
    """(feature, SHA-256) of the full-resolution RGB tensor, made strip by strip: width, height, the mean of each channel and of the steps between neighbours in a row, from whole numbers."""
    total, steps, count, sha = np.zeros(3, np.int64), 0, 0, hashlib.sha256()
    for strip in image.strips():
        sha.update(np.ascontiguousarray(strip))
        flat = strip.reshape(-1, 3)
        total += flat.sum(0, dtype=np.int64)
        green = strip[:, :, 1]
        steps += int(np.where(green[:, 1:] > green[:, :-1], green[:, 1:] - green[:, :-1], green[:, :-1] - green[:, 1:]).sum(dtype=np.int64))
        count += len(flat)
    means = " ".join(f"{v / max(1, count):.4f}" for v in [*total.tolist(), steps])
    return f"{image.width}x{image.height} {means}", sha.hexdigest()


def from_media(media: DataFrame, with_payload: bool = True, with_tensor: bool = True) -> DataFrame:
    """Adds to rows with a column media what the stored bytes hold: width, height, feature, payload (of store()), rgb, the full-resolution tensor in rows of uint8 triples, and rgb_sha256.

    A null media gives nulls. Columns that bear one of the new names are replaced, all others stay; repeated rows are read alike; an
    empty table gives no rows. Bytes that are no progressive JPEG fail the task: nothing is dropped in silence.
    """
    media = media.drop(*NEW)
    kept = [c for c in media.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([*(b.schema.field(c) for c in kept), ("width", pa.int64()), ("height", pa.int64()), ("feature", pa.string()), ("payload", pa.binary()), ("rgb", pa.binary()), ("rgb_sha256", pa.string())])

            def rows(b: pa.RecordBatch = b) -> Iterator[tuple]:
                for row in zip(*(b.column(c).to_pylist() for c in kept), strict=True):
                    data = row[kept.index("media")]
                    if data is None:
                        yield (*row, *[None] * len(NEW))
                        continue
                    image = jpeg.decode(data)
                    feature, digest = feature_of(image)
                    yield (*row, image.width, image.height, feature, jpeg.restore(image) if with_payload else None, image.rgb().tobytes() if with_tensor else None, digest)

            yield from _in_parts(rows(), schema, lambda r: len(r[kept.index("media")] or b"") + len(r[-3] or b"") + len(r[-2] or b""))

    small_batches(media.sparkSession)
    return media.mapInArrow(run, f"{fields}, width long, height long, feature string, payload binary, rgb binary, rgb_sha256 string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a stored JPEG and back: the media are written to the shared folder, read again, decoded to coefficients and RGB tensors.

    Payload, feature and digests come from what was read. The tensors are made whole, strip by strip, for feature and digest, and not kept.
    """
    rows = from_media(materialise(spark, to_media(table(spark, sf_dir, "documents")), "media", "zstd"), with_tensor=False)
    n = F.octet_length("payload")
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", n - 63, F.lit(64))).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "rgb_sha256",
    )
