"""Images as pixel rows (x, y, c, v): c is the channel, v 0..255. Geometry is re-keying, so images of any number and size stay
distributed; files are decoded and encoded in Arrow batches, one image to a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grey weights of red, green and blue, and the ten levels of text rendering.
GREY = (0.299, 0.587, 0.114)
RAMP = " .:-=+*#%@"


class Image:
    def __init__(self, df: DataFrame, width: int, height: int, channels: int):
        self.df, self.width, self.height, self.channels = df, width, height, channels
        self.spark = df.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, width: int, height: int, channels: int, value: Column) -> Image:
        k = spark.range(width * height * channels)
        px = k.select(F.expr(f"id div {channels} % {width}").cast("int").alias("x"), F.expr(f"id div {channels * width}").cast("int").alias("y"), F.expr(f"id % {channels}").cast("int").alias("c"))
        return cls(px.select("x", "y", "c", value.cast("int").alias("v")), width, height, channels)

    def _like(self, df: DataFrame, width: int | None = None, height: int | None = None, channels: int | None = None) -> Image:
        return Image(df.select("x", "y", "c", "v"), width or self.width, height or self.height, channels or self.channels)

    def _moved(self, x: Column, y: Column, width=None, height=None) -> Image:
        return self._like(self.df.select(x.cast("int").alias("x"), y.cast("int").alias("y"), "c", "v"), width, height)

    def grayscale(self) -> Image:
        """Weighted channels, truncated."""
        if self.channels < 3:
            return self._like(self.df.filter("c = 0"), channels=1)
        weight = F.element_at(F.array(*map(F.lit, GREY)), F.col("c") + 1)
        out = self.df.filter("c < 3").groupBy("x", "y").agg(F.floor(F.sum(F.col("v") * weight) + 1e-9).cast("int").alias("v"))
        return self._like(out.withColumn("c", F.lit(0)), channels=1)

    def resize(self, width: int, height: int) -> Image:
        """Nearest pixel by truncation: targets join the source pixel they fall on."""
        grid = Image.of(self.spark, width, height, self.channels, F.lit(0)).df.drop("v")
        at = grid.withColumn("sx", F.floor(F.col("x") * self.width / width).cast("int")).withColumn("sy", F.floor(F.col("y") * self.height / height).cast("int"))
        src = self.df.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "c", "v")
        return self._like(at.join(src, ["sx", "sy", "c"]), width, height)

    def crop(self, x: int, y: int, width: int, height: int) -> Image:
        """Clamped to the image."""
        x, y = max(0, min(x, self.width)), max(0, min(y, self.height))
        width, height = min(width, self.width - x), min(height, self.height - y)
        inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
        return Image(self.df.filter(inside).select((F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "c", "v"), width, height, self.channels)

    flip_horizontal = lambda self: self._moved(self.width - 1 - F.col("x"), F.col("y"))
    flip_vertical = lambda self: self._moved(F.col("x"), self.height - 1 - F.col("y"))
    rotate90 = lambda self: self._moved(self.height - 1 - F.col("y"), F.col("x"), self.height, self.width)
    rotate180 = lambda self: self._moved(self.width - 1 - F.col("x"), self.height - 1 - F.col("y"))
    rotate270 = lambda self: self._moved(F.col("y"), self.width - 1 - F.col("x"), self.height, self.width)
    fill = lambda self, v: self._like(self.df.withColumn("v", F.lit(int(v))))
    clear = lambda self: self.fill(0)
    at = lambda self, x, y: self.df.filter((F.col("x") == x) & (F.col("y") == y))

    def to_matrix(self):
        """Rows of pixels, channels side by side in a pixel."""
        from .matrix import Matrix

        cells = self.df.select(F.col("y").cast("long").alias("i"), (F.col("x") * self.channels + F.col("c")).cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        return Matrix(cells, self.height, self.width * self.channels)

    @classmethod
    def from_matrix(cls, m, channels: int = 1) -> Image:
        """Values cut to 0..255 and truncated."""
        v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v"))).cast("int")
        px = m.full().df.select(F.floor(F.col("j") / channels).cast("int").alias("x"), F.col("i").cast("int").alias("y"), (F.col("j") % channels).cast("int").alias("c"), v.alias("v"))
        return cls(px, m.cols // channels, m.rows, channels)

    def to_numpy(self) -> np.ndarray:
        out = np.zeros((self.height, self.width, self.channels), np.uint8)
        t = self.df.toArrow()
        out[np.asarray(t["y"]), np.asarray(t["x"]), np.asarray(t["c"])] = np.asarray(t["v"])
        return out

    def ascii(self) -> str:
        """Text on the driver, ten levels."""
        a = self.grayscale().to_numpy()[:, :, 0].astype(int)
        return "\n".join("".join(RAMP[v * (len(RAMP) - 1) // 255] for v in row) for row in a)

    def unicode_blocks(self) -> str:
        a = self.grayscale().to_numpy()[:, :, 0].astype(int)
        return "\n".join("".join(" ░▒▓█"[v * 4 // 255] for v in row) for row in a)

    def save(self, path: str) -> None:
        """BMP, PPM (colour) or PGM (grey) by extension, to a driver file."""
        with open(path, "wb") as f:
            f.write(encode(self.to_numpy(), path.rsplit(".", 1)[-1].lower()))


def test_pattern(spark, width: int, height: int) -> Image:
    x, y = F.col("x"), F.col("y")
    return Image.of(spark, width, height, 3, F.when(F.col("c") == 0, x * 255 / width).when(F.col("c") == 1, y * 255 / height).otherwise((x + y) * 255 / (width + height)))


def gradient(spark, width: int, height: int) -> Image:
    return Image.of(spark, width, height, 1, F.col("x") * 255 / max(width - 1, 1))


def checkerboard(spark, width: int, height: int, square: int = 8) -> Image:
    return Image.of(spark, width, height, 1, F.when((F.floor(F.col("x") / square) + F.floor(F.col("y") / square)) % 2 == 0, 255).otherwise(0))


def circle(spark, size: int) -> Image:
    r = size / 2.0
    return Image.of(spark, size, size, 1, F.when(F.hypot(F.col("x") - r, F.col("y") - r) <= r * 0.8, 255).otherwise(0))


def encode(a: np.ndarray, kind: str) -> bytes:
    h, w, c = a.shape
    rgb = a[:, :, :3] if c >= 3 else np.repeat(a[:, :, :1], 3, 2)
    if kind == "pgm":
        grey = a[:, :, 0] if c < 3 else (rgb @ np.array(GREY)).astype(np.uint8)
        return f"P5\n{w} {h}\n255\n".encode() + np.ascontiguousarray(grey).tobytes()
    if kind == "ppm":
        return f"P6\n{w} {h}\n255\n".encode() + np.ascontiguousarray(rgb).tobytes()
    if kind == "bmp":
        line = (3 * w + 3) // 4 * 4
        body = np.zeros((h, line), np.uint8)
        body[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
        head = np.array([14 + 40 + line * h, 0, 54, 40, w, h], "<u4").tobytes() + np.array([1, 24], "<u2").tobytes() + np.array([0, line * h, 2835, 2835, 0, 0], "<u4").tobytes()
        return b"BM" + head + body.tobytes()
    raise ValueError(f"images are not written as {kind}")


def decode(raw: bytes) -> np.ndarray:
    """BMP (24 or 32 bits), PPM or PGM (plain or raw)."""
    if raw[:2] == b"BM":
        start, = np.frombuffer(raw, "<u4", 1, 10)
        w, h = np.frombuffer(raw, "<i4", 2, 18).tolist()
        bits, = np.frombuffer(raw, "<u2", 1, 28)
        n = int(bits) // 8
        line = (n * w + 3) // 4 * 4
        a = np.frombuffer(raw, np.uint8, line * abs(h), int(start)).reshape(abs(h), line)[:, : n * w].reshape(abs(h), w, n)
        return np.ascontiguousarray((a[::-1] if h > 0 else a)[:, :, [2, 1, 0]])
    kind = raw[:2]
    if kind in (b"P2", b"P3", b"P5", b"P6"):
        tokens, at = [], 2
        while len(tokens) < 3:
            while raw[at : at + 1].isspace():
                at += 1
            if raw[at : at + 1] == b"#":
                at = raw.index(b"\n", at)
                continue
            end = at
            while not raw[end : end + 1].isspace():
                end += 1
            tokens.append(int(raw[at:end]))
            at = end
        w, h, most = tokens
        c = 3 if kind in (b"P3", b"P6") else 1
        v = np.frombuffer(raw, np.uint8, w * h * c, at + 1) if kind in (b"P5", b"P6") else np.array(raw[at:].split(), float)[: w * h * c]
        return (v.astype(float) * 255 / most).astype(np.uint8).reshape(h, w, c) if most != 255 else v.astype(np.uint8).reshape(h, w, c)
    raise ValueError("not a BMP, PPM or PGM image")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data): a row per image file. JPEG and PNG come through Spark's image source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = decode(raw)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a.shape[1]], pa.int32()), pa.array([a.shape[0]], pa.int32()), pa.array([a.shape[2]], pa.int32()), pa.array([a.tobytes()])], ["path", "width", "height", "channels", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, channels int, data binary")


def load_image(spark: SparkSession, path: str) -> Image:
    """One image: its size comes to the driver, its pixels stay in Spark."""
    if path.lower().rsplit(".", 1)[-1] in ("jpg", "jpeg", "png"):
        rows = spark.read.format("image").load(path).select("image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
        turn = True  # the image source keeps blue first
    else:
        rows, turn = read_images(spark, path).drop("path"), False
    size = rows.select("width", "height", "channels").first()
    w, h, c = size

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                a = np.frombuffer(raw, np.uint8)
                k = np.arange(len(a))
                ch = k % c
                if turn and c >= 3:
                    ch = np.where(ch < 3, 2 - ch, ch)
                yield pa.RecordBatch.from_arrays([pa.array((k // c % w).astype(np.int32)), pa.array((k // (c * w)).astype(np.int32)), pa.array(ch.astype(np.int32)), pa.array(a.astype(np.int32))], ["x", "y", "c", "v"])

    return Image(rows.select("data").mapInArrow(pixels, "x int, y int, c int, v int"), w, h, c)
