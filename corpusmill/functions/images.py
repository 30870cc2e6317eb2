"""Image geometry on arrays: tilings, resizing, patches, pooling indices, multi-crop preprocessing.

Images are (height, width, bytes) rows of 8-bit RGB.  Spark's own "image" source decodes files; no other decoder is needed here.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.packing import IMAGE_END_ID, IMAGE_START_ID, PATCH_ID, ROW_END_ID

PATCH = 14
CROP = 378  # 27 patches of 14
MARGIN_PATCHES = 4
POOL = 2


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, data) of image files: RGB, decoded by Spark; files that can't be decoded have no row."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*").filter("nChannels in (1, 3)")

    def to_rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for channels, raw in zip(batch.column("nChannels").to_pylist(), batch.column("data").to_pylist(), strict=True):
                pixels = np.frombuffer(raw, np.uint8).reshape(-1, channels)
                data.append(np.repeat(pixels, 3, axis=1).tobytes() if channels == 1 else pixels[:, ::-1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("origin"), batch.column("height"), batch.column("width"), pa.array(data, pa.binary())], names=["image_id", "height", "width", "data"])

    return rows.mapInArrow(to_rgb, "image_id string, height int, width int, data binary")


def _bitmap(height: int, width: int, data: bytes) -> bytes:
    """An uncompressed 24-bit BMP file of RGB pixels: rows from the bottom, padded to whole words, blue first."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, 3 * width)
    body = np.pad(pixels, ((0, 0), (0, -3 * width % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_images(images: DataFrame, path: str, key: str = "image_id") -> None:
    """One file <path>/<key>.bmp for each image (key, height, width, data); files get their names when they are whole."""

    def run(rows: Iterator) -> None:
        for row in rows:
            system, base = fs.FileSystem.from_uri(path)
            system.create_dir(base, recursive=True)
            name = f"{base}/{row[key]}"
            with system.open_output_stream(f"{name}.part") as f:
                f.write(_bitmap(row["height"], row["width"], bytes(row["data"])))
            system.move(f"{name}.part", f"{name}.bmp")

    images.select(key, "height", "width", "data").foreachPartition(run)


def patch_sums(images: DataFrame, patch: int = PATCH) -> DataFrame:
    """(image_id, patch, total, half): the sum of each patch's values from 0 to 255, and of the same patch after the image has been resized to half its
    sides (null beyond the smaller image); sides are multiples of two patches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, h, w, data = (batch.column(c)[i].as_py() for c in ("image_id", "height", "width", "data"))
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                whole = to_patches(image.astype(np.int64), patch).sum(axis=1)
                small = to_patches(np.rint((resize(image, h // 2, w // 2).astype(np.float64) + 1) * 127.5 * 4), patch).sum(axis=1) / 4  # quarters are exact
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(whole)), pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole), pa.array(small.tolist() + [None] * (len(whole) - len(small)), pa.float64())], ["image_id", "patch", "total", "half"])

    return images.select("image_id", "height", "width", "data").mapInArrow(run, "image_id string, patch int, total bigint, half double")


def tilings(spark: SparkSession, most: int) -> DataFrame:
    """(rows, cols) with at most ``most`` tiles, a dimension of a few dozen rows."""
    pairs = [(i, j) for i in range(1, most + 1) for j in range(1, most // i + 1)]
    return spark.createDataFrame(pairs, "rows int, cols int")


def choose_tiling(images: DataFrame, most: int, tile: int, key: str = "image_id") -> DataFrame:
    """(key, rows, cols): the tiling that needs the least enlargement, or, where all shrink the image, the one that shrinks it least.

    Ties go to fewer tiles, then to fewer rows.  Every image meets the few tilings of the dimension table as an array."""
    table = tilings(images.sparkSession, most).agg(F.array_sort(F.collect_list(F.struct((F.col("rows") * F.col("cols")).alias("n"), "rows", "cols"))).alias("_t"))
    rows = images.join(F.broadcast(table))  # one row
    scale = lambda t: F.least(t["rows"] * tile / F.col("height"), t["cols"] * tile / F.col("width"))
    rows = rows.withColumn("_t", F.transform("_t", lambda t, i: F.struct(scale(t).alias("s"), i.alias("i"), t["rows"].alias("rows"), t["cols"].alias("cols"))))
    grows = F.filter("_t", lambda t: t["s"] >= 1)
    best = F.when(F.size(grows) > 0, F.array_min(grows)).otherwise(F.array_min(F.transform("_t", lambda t: F.struct((-t["s"]).alias("s"), t["i"].alias("i"), t["rows"].alias("rows"), t["cols"].alias("cols")))))
    return rows.select(key, best["rows"].alias("rows"), best["cols"].alias("cols"))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear between the two nearest pixels, whose centres are at halves, without smoothing when it shrinks; values in [-1, 1]."""

    def places(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(to, dtype=np.float32) + np.float32(0.5)) * np.float32(size / to) - np.float32(0.5), 0)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, np.minimum(low + 1, size - 1), (at - low).astype(np.float32)

    (top, bottom, down), (left, right, along) = places(image.shape[0], height), places(image.shape[1], width)
    pixels = image.astype(np.float32)
    mixed = pixels[:, left] * (1 - along)[None, :, None] + pixels[:, right] * along[None, :, None]
    out = mixed[top] * (1 - down)[:, None, None] + mixed[bottom] * down[:, None, None]
    return (np.clip(out, 0, 255) / np.float32(255) * 2 - 1).astype(np.float32)


def to_patches(image: np.ndarray, patch: int = PATCH) -> np.ndarray:
    """(patches, patch * patch * channels), row by row."""
    h, w, c = image.shape
    return image.reshape(h // patch, patch, w // patch, patch, c).transpose(0, 2, 1, 3, 4).reshape(-1, patch * patch * c)


def pooling_index(grid: np.ndarray, pool: int = POOL) -> np.ndarray:
    """(cells, pool * pool) patch numbers of each pooled cell; -1 beyond the edges."""
    h, w = grid.shape
    top, left = (-h % pool) // 2, (-w % pool) // 2
    padded = np.pad(grid, ((top, -h % pool - top), (left, -w % pool - left)), constant_values=-1)
    h, w = padded.shape
    return padded.reshape(h // pool, pool, w // pool, pool).transpose(0, 2, 1, 3).reshape(-1, pool * pool)


def token_layout(rows: int, cols: int) -> list[int]:
    """Ids of a grid of pooled cells: a start, each row's place holders and its end mark, an end."""
    return [IMAGE_START_ID, *([*[PATCH_ID] * cols, ROW_END_ID] * rows), IMAGE_END_ID]


def multi_crop(image: np.ndarray, most: int, crop: int = CROP, patch: int = PATCH, margin: int = MARGIN_PATCHES, pool: int = POOL) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Token ids, patches of the whole image and of its overlapping crops, and the pooled cells' patch numbers, whole image first.

    Neighbouring crops share 2 * margin patches; a patch in a shared border counts in the crop where it is further inside."""
    side = crop // patch
    inner = side - 2 * margin
    candidates = sorted(((i * j, i, j) for i in range(1, most + 1) for j in range(1, most // i + 1)))
    edge = 2 * margin * patch
    scale = [min((i * inner * patch) / max(image.shape[0] - edge, 1), (j * inner * patch) / max(image.shape[1] - edge, 1)) for _, i, j in candidates]
    fits = [k for k, s in enumerate(scale) if s >= 1]
    _, rows, cols = candidates[min(fits, key=lambda k: scale[k]) if fits else max(range(len(scale)), key=lambda k: scale[k])]
    big = resize(image, (rows * inner + 2 * margin) * patch, (cols * inner + 2 * margin) * patch)
    patches = [to_patches(resize(image, crop, crop), patch)]
    grid = np.full((rows * inner + 2 * margin, cols * inner + 2 * margin), -1, np.int64)
    for r in range(rows):
        for c in range(cols):
            y, x = r * inner, c * inner
            number = (len(patches)) * side * side + np.arange(side * side).reshape(side, side)
            patches.append(to_patches(big[y * patch : (y + side) * patch, x * patch : (x + side) * patch], patch))
            a, b = (0 if r == 0 else margin), (side if r == rows - 1 else side - margin)
            d, e = (0 if c == 0 else margin), (side if c == cols - 1 else side - margin)
            grid[y + a : y + b, x + d : x + e] = number[a:b, d:e]
    whole = np.arange(side * side).reshape(side, side)
    ids = [t for g in (whole, grid) for t in token_layout(*(-(-n // pool) for n in g.shape))]
    return ids, np.stack(patches), np.concatenate([pooling_index(g, pool) for g in (whole, grid)])


def preprocess(images: DataFrame, most: int, key: str = "image_id") -> DataFrame:
    """(key, crops, ids, patches, pooled): token ids, flattened float32 bytes of all patches, and the pooled cells' patch numbers.

    ``images``: (key, height, width, data), and ``most`` where images have limits of their own."""
    own = ["most"] if "most" in images.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one image at a time bounds memory
                name, h, w, data, *limit = (batch.column(c)[i].as_py() for c in (key, "height", "width", "data", *own))
                ids, patches, pooled = multi_crop(np.frombuffer(data, np.uint8).reshape(h, w, 3), *limit or [most])
                yield pa.RecordBatch.from_arrays([pa.array([name], batch.schema.field(key).type), pa.array([len(patches)], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([patches.astype("<f4").tobytes()]), pa.array([pooled.tolist()], pa.list_(pa.list_(pa.int64())))], names=[key, "crops", "ids", "patches", "pooled"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "data", *own).mapInArrow(run, f"{key} {kind}, crops int, ids array<int>, patches binary, pooled array<array<bigint>>")


def image_prefix(number: int) -> str:
    """Text before an image's tokens; the first image has none."""
    return f" Image {number + 1}: " if number else ""


def image_segments(rows: DataFrame, prepared: DataFrame, encode: Callable[[str], list[int]], patches_per_crop: int, most: int = 5, key: str = "id") -> DataFrame:
    """(key, image_ids, crops, pooled): the first ``most`` images of each row as one run of tokens, each but the first after its
    prefix, with patch numbers counted through the row's crops.

    ``rows``: (key, images); ``prepared``: (image, crops, ids, pooled).  A row without images has none of either."""
    prefixes = F.array(*(F.array(*(F.lit(t) for t in encode(image_prefix(i)))).cast("array<int>") if i else F.array().cast("array<int>") for i in range(most)))  # a constant
    listed = rows.select(key, F.posexplode(F.slice("images", 1, most)).alias("no", "image"))
    own = listed.join(prepared.select("image", "crops", "ids", "pooled"), "image")
    before = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("shift", F.coalesce(F.sum("crops").over(before), F.lit(0)) * patches_per_crop)
    moved = F.transform("pooled", lambda row: F.transform(row, lambda x: F.when(x >= 0, x + F.col("shift")).otherwise(F.lit(-1).cast("bigint"))))
    parts = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", F.concat(F.get(prefixes, F.col("no")), F.col("ids")).alias("ids"), "crops", moved.alias("pooled")))).alias("x"))
    parts = parts.select(key, F.flatten(F.transform("x", lambda x: x["ids"])).alias("image_ids"), F.aggregate("x", F.lit(0), lambda a, x: a + x["crops"]).alias("crops"), F.flatten(F.transform("x", lambda x: x["pooled"])).alias("pooled"))
    whole = rows.select(key).join(parts, key, "left")
    return whole.select(key, F.coalesce("image_ids", F.array().cast("array<int>")).alias("image_ids"), F.coalesce("crops", F.lit(0)).alias("crops"), F.coalesce("pooled", F.array().cast("array<array<bigint>>")).alias("pooled"))


def row_segments(rows: DataFrame, images: DataFrame, encode: Callable[[str], list[int]], patches_per_crop: int, crops: int, crops_of_several: int, most: int = 5, key: str = "id") -> DataFrame:
    """``image_segments`` of rows (key, images) straight from pixels (image, height, width, data): the images of a row with several are cut into fewer
    crops each (``crops_of_several``) than a single one (``crops``).

    An image is cut once for each limit that rows ask for, and only images that rows hold are cut."""
    limit = F.when(F.size("images") > 1, crops_of_several).otherwise(crops)
    asked = rows.select(key, F.slice("images", 1, most).alias("images"), limit.alias("most"))
    name = lambda image, most: F.concat_ws("|", most.cast("string"), image.cast("string"))
    wanted = asked.select(F.explode("images").alias("image"), "most").distinct()
    cut = preprocess(wanted.join(images, "image").withColumn("cut", name(F.col("image"), F.col("most"))), crops, "cut").withColumnRenamed("cut", "image")
    named = asked.select(key, F.transform("images", lambda x: name(x, F.col("most"))).alias("images"))
    return image_segments(named, cut, encode, patches_per_crop, most, key)


def synthetic_images(spark: SparkSession, n: int, seed: int, share: float = 0.8, side: int = 32) -> DataFrame:
    """(image_id, height, width, data, answer): random pixels for a share of the rows, and an answer of 4 to 23 token ids from 1000 to 5999."""
    pick = lambda salt: F.pmod(F.xxhash64("image_id", F.lit(seed), F.lit(salt)), F.lit(1000))

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.random.default_rng((seed, i)).integers(0, 256, side * side * 3, dtype=np.uint8).tobytes() if has else None for i, has in zip(batch.column("image_id").to_pylist(), batch.column("has").to_pylist(), strict=True)]
            yield batch.append_column("data", pa.array(data, pa.binary()))

    rows = spark.range(n).select(F.col("id").alias("image_id"), (pick("image") < 1000 * share).alias("has"), (4 + pick("length") % 20).cast("int").alias("n_answer"))
    out = rows.mapInArrow(pixels, "image_id bigint, has boolean, n_answer int, data binary")
    return out.select("image_id", F.when(F.col("has"), side).alias("height"), F.when(F.col("has"), side).alias("width"), "data", F.transform(F.sequence(F.lit(1), F.col("n_answer")), lambda i: F.pmod(F.xxhash64("image_id", i, F.lit(seed)), F.lit(5000)).cast("int") + 1000).alias("answer"))
