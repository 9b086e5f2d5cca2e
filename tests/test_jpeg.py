"""The JPEG encoder, read back by Spark's image source."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenpick.functions import jpeg


def pictures():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:61, 0:90]
    smooth = np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 60 + x], axis=-1)
    return {
        "gray.jpg": np.clip(smooth[..., 0], 0, 255).astype(np.uint8), "colour.jpg": np.clip(smooth, 0, 255).astype(np.uint8), "noise.jpg": rng.integers(0, 256, (33, 47, 3)).astype(np.uint8),
        "flat.jpg": np.full((8, 8), 200, np.uint8), "dot.jpg": np.full((1, 1, 3), 7, np.uint8), "edges.jpg": (np.indices((64, 40)).sum(axis=0) // 16 % 2 * 255).astype(np.uint8),
    }


@pytest.mark.parametrize(("quality", "bounds"), [(82, (2.5, 3.5, 26)), (100, (1.0, 1.6, 1.6)), (30, (6, 8, 60))])
def test_pictures_are_decoded_within_bounds(spark, tmp_path, quality, bounds):
    for name, image in pictures().items():
        (tmp_path / name).write_bytes(jpeg.encoded_jpeg(image, quality))
    got = {r["origin"].rsplit("/", 1)[1]: r for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    limits = {"gray.jpg": bounds[0], "colour.jpg": bounds[1], "noise.jpg": bounds[2], "flat.jpg": 1, "dot.jpg": 3, "edges.jpg": bounds[0] * 2}
    for name, image in pictures().items():
        r = got[name]
        data = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(int)
        data = data[..., 2::-1] if image.ndim == 3 else data[..., 0]
        assert data.shape == image.shape and np.abs(data - image).mean() <= limits[name], (name, np.abs(data - image).mean())


def test_coefficients_equal_the_direct_formula():
    plane = np.random.default_rng(1).integers(0, 256, (8, 16))
    table = jpeg.quantisation(jpeg.LUMINANCE, 82)
    got = jpeg.coefficients(plane, table)
    for b in range(2):
        block = plane[:, 8 * b : 8 * b + 8] - 128.0
        for k, at in enumerate(jpeg._ZIGZAG):
            u, v = divmod(int(at), 8)
            total = sum(block[i, j] * np.cos((2 * i + 1) * u * np.pi / 16) * np.cos((2 * j + 1) * v * np.pi / 16) for i in range(8) for j in range(8))
            scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
            assert abs(got[b, k] - total * scale / table[at]) <= 0.5 + 1e-9
    assert jpeg._ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg._ZIGZAG[-1] == 63


def test_codes_are_prefix_free_and_short():
    rng = np.random.default_rng(2)
    for symbols in (np.array([5]), np.repeat(np.arange(40), 2 ** np.minimum(np.arange(40), 20)), rng.integers(0, 200, 5000)):
        lengths = jpeg.code_lengths(symbols)
        assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    assert len(jpeg.encoded_jpeg(pictures()["colour.jpg"])) < pictures()["colour.jpg"].size // 4


def test_thumbnails_are_jpeg(spark, tmp_path):
    from lumenpick.operators.thumbnails import write_thumbnails
    from lumenpick.sources import photos

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_a.jpg").write_bytes(jpeg.encoded_jpeg(pictures()["colour.jpg"].repeat(8, axis=0).repeat(8, axis=1)))
    done = write_thumbnails(photos.decoded(spark, str(tmp_path / "in")), str(tmp_path / "small")).first()
    assert done.error is None and done.thumbnail_path.endswith(".jpg") and open(done.thumbnail_path, "rb").read(3) == b"\xff\xd8\xff"
    small = photos.decoded(spark, str(tmp_path / "small")).select("image.*").first()
    assert (small.width, small.height) == (360, 244) and spark.read.format("image").load(str(tmp_path / "small")).filter(F.col("image.height") > 0).count() == 1
