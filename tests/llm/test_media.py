import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import jpeg, media

SCHEMA = "doc_id long, text string, id string, media string, n_bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("blocks", [1, 2, 6, 7, 100, 32767 // 4 * 6 + 17])
def test_round_trip(blocks):
    payload = random.Random(blocks).randbytes(64 * blocks)
    assert jpeg.restore(jpeg.decode(jpeg.store(payload))) == payload


@pytest.mark.parametrize("byte", [0, 127, 128, 255])
def test_round_trip_of_constant_bytes(byte):
    assert jpeg.restore(jpeg.decode(jpeg.store(bytes([byte]) * 640))) == bytes([byte]) * 640


def read_by_jvm(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    if image.getRaster().getNumBands() == 1:
        gray = np.array([[image.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
        return np.repeat(gray[:, :, None], 3, 2)
    out = np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return np.stack([out >> 16, out >> 8 & 255, out & 255], 2).astype(int)


def write_by_jvm(spark, rgb, gray=False):
    """A progressive JPEG with general Huffman codes, end-of-band runs and refinements, made by another encoder."""
    jvm = spark._jvm
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def test_another_decoder_reads_what_is_stored(spark):
    data = jpeg.store(random.Random(1).randbytes(64 * 30))
    image = jpeg.decode(data)
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(data))))
    raster = reader.readRaster(0, None)  # luma and chroma as they are decoded
    assert (raster.getWidth(), raster.getHeight()) == (image.width, image.height)
    theirs = np.array([[raster.getSample(x, y, 0) for x in range(image.width)] for y in range(image.height)])
    c = image.components[1]
    samples = (c.coefficients.reshape(-1, 64).astype(np.float32) @ jpeg.IDCT).reshape(c.rows, c.cols, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, -1) + 128
    assert np.abs(np.clip(np.rint(samples), 0, 255) - theirs).max() <= 1


@pytest.mark.parametrize("shape", [(8, 8), (17, 23), (40, 33)])
def test_general_scans_of_gray_images(spark, shape):
    rng = np.random.default_rng(0)
    x = np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) + rng.integers(0, 60, shape)
    rgb = np.repeat(np.clip(x, 0, 255)[:, :, None], 3, 2)
    data = write_by_jvm(spark, rgb, gray=True)
    assert b"\xff\xc2" in data
    assert np.abs(jpeg.decode(data).rgb().astype(int) - read_by_jvm(spark, data)).max() <= 1


def test_general_scans_of_colour_images(spark):
    y, x = np.mgrid[0:37, 0:45]
    rgb = np.stack([120 + 2 * x, 60 + 3 * y, np.full_like(x, 90)], 2) % 256
    rgb = np.clip(rgb + np.random.default_rng(1).integers(-9, 9, rgb.shape[:2])[:, :, None], 0, 255)
    data = write_by_jvm(spark, rgb)
    diff = np.abs(jpeg.decode(data).rgb().astype(int) - read_by_jvm(spark, data))
    assert diff.mean() < 3


def test_one_sized_codes_equal_bit_by_bit_decoding(monkeypatch):
    data = jpeg.store(random.Random(4).randbytes(64 * 30))
    fast = jpeg.decode(data)

    class Other(dict):  # the same codes, under which the short way does not recognise its own
        def get(self, key, default=None):
            return default

    plain = jpeg._scan
    monkeypatch.setattr(jpeg, "_scan", lambda d, i, im, ids, dc, ac, *a: plain(d, i, im, ids, {k: Other(v) for k, v in dc.items()}, {k: Other(v) for k, v in ac.items()}, *a))
    slow = jpeg.decode(data)
    for k, c in fast.components.items():
        assert np.array_equal(c.coefficients, slow.components[k].coefficients)


def test_strips_make_the_whole():
    image = jpeg.decode(jpeg.store(random.Random(2).randbytes(64 * 500)))
    assert np.array_equal(np.concatenate(list(image.strips(7))), image.rgb())
    assert image.rgb().shape == (image.height, image.width, 3)


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_what_is_no_progressive_jpeg_is_refused(data):
    with pytest.raises(ValueError):
        jpeg.decode(data)


ROWS = [(1, None), (2, ""), (3, "x" * 64), (3, "x" * 64), (None, "é" * 33), (4, "long \U0001f389 " * 40_000), (5, "a\0b")]


def test_documents(spark, tmp_path):
    frame(spark, ROWS).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted((r.asDict() for r in media.op4_media(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = jpeg.store(payload)
        want.append({
            "doc_id": i, "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
            "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": media.feature_of(jpeg.decode(stored))[0], "rgb_sha256": hashlib.sha256(jpeg.decode(stored).rgb().tobytes()).hexdigest(),
        })
    assert out == sorted(want, key=str)


def test_tensor_column_and_nulls(spark):
    rows = spark.createDataFrame([(1, bytearray(jpeg.store(b"a" * 64))), (2, None)], "key int, media binary")
    out = {r.key: r for r in media.from_media(rows).collect()}
    assert len(out[1].rgb) == out[1].width * out[1].height * 3 and bytes(out[1].payload) == b"a" * 64
    assert out[1].rgb_sha256 == hashlib.sha256(out[1].rgb).hexdigest()
    assert out[2].rgb is None and out[2].feature is None
    clashing = rows.selectExpr("'w' as width", "media", "1 as height", "key", "2.0 as rgb", "3 as feature", "'p' as payload")
    again = {r.key: r for r in media.from_media(clashing).collect()}
    assert again[1].width == out[1].width and again[1].rgb == out[1].rgb and again[2].rgb is None
    assert media.from_media(rows.limit(0)).collect() == []
    assert media.to_media(frame(spark, [])).collect() == []
