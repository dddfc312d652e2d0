"""Frames from files: image sequences, discovery of videos and frame folders, pixels, and decoders that can be plugged in."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import IMAGE_TYPES, VIDEO_TYPES, extension, source_kind
from ..operators import sampling, tiles
from ..operators.lineage import numbered
from . import video
from .files import opened

PIXELS = "camera_id string, frame_idx int, y int, x int, b int, g int, r int"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_idx, path) of the images right in a folder, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path")
    images = files.where(extension(F.col("path")).isin(*IMAGE_TYPES))
    return numbered(images, "at", "path").select(F.col("at").cast("int").alias("frame_idx"), "path")


def image_folders(spark: SparkSession, root: str) -> DataFrame:
    """(file_path): the folders below `root`, and it itself, that have images right in them."""
    images = paths(spark, root).where(extension(F.col("path")).isin(*IMAGE_TYPES))
    return images.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("file_path")).distinct()


def read_images(spark: SparkSession, folder: str, camera_id: str = "camera") -> DataFrame:
    """(camera_id, frame_idx, height, width, n_channels, data, timestamp_ms): unreadable images are left out, numbers close up.

    Which images can be read is known only by decoding them: once for the numbers and once for the data. Samplers do without, see
    `sample_images`.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*").where(extension(F.col("origin")).isin(*IMAGE_TYPES))
    index = numbered(images.select("origin"), "at", "origin").select("origin", F.col("at").cast("int").alias("frame_idx"))
    return images.join(index, "origin").select(F.lit(camera_id).alias("camera_id"), "frame_idx", "height", "width", F.col("nChannels").alias("n_channels"), "data", F.lit(0.0).alias("timestamp_ms"))


def _plain(path):
    """A path as both listings and images spell it: one slash behind the scheme, nothing encoded."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+:)/+", "$1/")


def images_at(chosen: DataFrame, camera_id: str = "camera") -> DataFrame:
    """Frames, as of `read_images`, of the files of `chosen` (frame_idx, path) only; unreadable ones are skipped, numbers stay.

    `chosen` is a sample: its paths go to the driver, which names them to the image source, so no other file is opened.
    """
    spark = chosen.sparkSession
    picked = chosen.select("frame_idx", "path").collect()
    if not picked:
        return spark.createDataFrame([], "camera_id string, frame_idx int, height int, width int, n_channels int, data binary, timestamp_ms double")
    named = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in picked]
    images = spark.read.format("image").option("dropInvalid", True).load(named).select("image.*")
    index = spark.createDataFrame(picked, "frame_idx int, __path string").withColumn("__at", _plain("__path"))
    at = _plain(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))))
    found = images.withColumn("__at", at).join(F.broadcast(index), "__at")
    return found.select(F.lit(camera_id).alias("camera_id"), "frame_idx", "height", "width", F.col("nChannels").alias("n_channels"), "data", F.lit(0.0).alias("timestamp_ms"))


def sample_images(spark: SparkSession, folder: str, num: int, camera_id: str = "camera", start_ratio: float = 0.0, end_ratio: float = 1.0) -> DataFrame:
    """The frames of a folder at the uniform indices; files are numbered by their paths alone, and only the sampled ones are opened."""
    return images_at(sampling.sample_frames(image_files(spark, folder), num, start_ratio, end_ratio), camera_id)


def image_at(spark: SparkSession, folder: str, index: int, camera_id: str = "camera") -> DataFrame:
    """The frame of a folder with that number; no row if there is none or it can't be read."""
    return images_at(sampling.frame_at(image_files(spark, folder), index), camera_id)


def sampled_source(spark: SparkSession, path: str, is_dir: bool, num: int, decoder: Callable | None = None, camera_id: str = "camera") -> DataFrame:
    """`num` frames of a folder of images or of a video at the uniform indices, without decoding the others where the decoder can seek."""
    if is_dir:
        return sample_images(spark, path, num, camera_id)
    seen = video.metadata(spark.createDataFrame([(path,)], "path string")).first()
    if seen.error is not None or not seen.frame_count:
        return sampling.sample_frames(open_source(spark, path, is_dir, decoder, camera_id), num)
    wanted = sorted({r.frame_idx for r in sampling.uniform_indices(spark, seen.frame_count, num).collect()})
    return decode_files(spark.createDataFrame([(path,)], "path string"), decoder, camera_id, wanted)


def _image(r: dict):
    """The image of a row with 1, 3 or 4 channels as (height, width, 3), blue first; grey fills all three."""
    import numpy as np

    a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
    return np.repeat(a, 3, axis=2) if r["n_channels"] == 1 else a[:, :, :3]


FRAME = ["camera_id", "frame_idx", "height", "width", "n_channels", "data"]


def to_pixels(frames: DataFrame) -> DataFrame:
    """Pixel rows of frames."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for r in tiles.rows(batches):
            a = _image(r)
            for y in range(0, r["height"], 64):
                part = a[y : y + 64].reshape(-1, 3)
                ys, xs = np.divmod(np.arange(len(part)), r["width"])
                yield pa.RecordBatch.from_arrays([pa.array([r["camera_id"]] * len(part)), pa.array(np.full(len(part), r["frame_idx"]), pa.int32()), pa.array(ys + y, pa.int32()), pa.array(xs, pa.int32()), *[pa.array(part[:, i], pa.int32()) for i in range(3)]], names=["camera_id", "frame_idx", "y", "x", "b", "g", "r"])

    return frames.select(*FRAME).mapInArrow(run, PIXELS)


def to_tiles(frames: DataFrame, size: int = tiles.SIZE) -> DataFrame:
    """Tiles of frames, see `operators.tiles`."""
    import pyarrow as pa

    def run(batches):
        for r in tiles.rows(batches):
            for y, x, h, w, data in tiles.cut(_image(r), size):
                yield pa.RecordBatch.from_arrays([pa.array([r["camera_id"]], pa.string()), *[pa.array([v], pa.int32()) for v in (r["frame_idx"], y, x, h, w, r["height"], r["width"])], pa.array([data], pa.binary())], names=["camera_id", "frame_idx", "ty", "tx", "h", "w", "height", "width", "data"])

    return frames.select(*FRAME).mapInArrow(run, tiles.SCHEMA)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as the engine's own listings spell it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return where.getFileSystem(conf).makeQualified(where).toString().rstrip("/")


def paths(spark: SparkSession, root: str) -> DataFrame:
    """All file paths below a folder but those of empty files; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def is_video(path: str) -> bool:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower() in VIDEO_TYPES


def discover_videos(files: DataFrame) -> DataFrame:
    """Rows of files(path) that are videos, whatever the case of their type."""
    return files.where(extension(F.col("path")).isin(*VIDEO_TYPES))


def discover_batch(files: DataFrame, folder: str) -> DataFrame:
    """(path, place): files right in `folder` with .mp4, then .avi, then .mov, in lower case only."""
    inside = files.where(F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == folder.rstrip("/"))
    kind = F.regexp_extract("path", r"\.([^./]+)$", 1)
    place = F.when(kind == "mp4", 0).when(kind == "avi", 1).when(kind == "mov", 2)
    return inside.withColumn("place", place).where("place is not null").orderBy("place", "path")


def _glob(pattern: str) -> str:
    """A glob over folder names as a regular expression: ** is any number of levels, * and ? stay in one."""
    kinds = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(kinds.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", pattern))


def discover_frame_folders(files: DataFrame, pattern: str = "**/CMR_GT_Frame", base: str = "") -> DataFrame:
    """(frame_dir), sorted: the folders below `base` with files in or below them whose path from there fits the glob."""
    folder = F.split(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/")
    folders = files.select(folder.alias("parts")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    found = folders.select(F.explode(above).alias("frame_dir")).where(F.col("frame_dir").rlike(f"^{re.escape(base.rstrip('/'))}/{_glob(pattern)}$"))
    return found.distinct().orderBy("frame_dir")


def frame_folder_images(files: DataFrame) -> DataFrame:
    """(frame_dir, frame_idx, path): each folder's .jpg files by path; its .JPG files only if it has no .jpg."""
    f = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("frame_dir"), "path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind")).where("kind in ('jpg', 'JPG')")
    best = F.min(F.when(F.col("kind") == "jpg", 0).otherwise(1)).over(W.partitionBy("frame_dir"))
    chosen = f.withColumn("__best", best).where((F.col("kind") == "jpg") == (F.col("__best") == 0))
    return chosen.select("frame_dir", (F.row_number().over(W.partitionBy("frame_dir").orderBy("path")) - 1).cast("int").alias("frame_idx"), "path")


def open_source(spark: SparkSession, path: str, is_dir: bool, decoder: Callable | None = None, camera_id: str = "camera") -> DataFrame:
    """Frames of a folder of images or of a video; other paths raise."""
    kind = spark.range(1).select(source_kind(F.lit(path), F.lit(is_dir))).first()[0]
    if kind == "image_sequence":
        return read_images(spark, path, camera_id)
    if kind == "video":
        return decode_files(spark.createDataFrame([(path,)], "path string"), decoder, camera_id)
    raise ValueError(f"unsupported source: {path}")


def decode_files(videos: DataFrame, decoder: Callable | None, camera_id: str = "camera", wanted: list[int] | None = None) -> DataFrame:
    """As `decode_videos`, of videos (path): tasks open the files themselves, however long these are, and send on `wanted` frames only.

    A decoder of two arguments gets the open file and the wanted numbers (None: all), so that it can seek; one of one argument gets
    the file's bytes.
    """
    if decoder is None:
        raise RuntimeError("no video decoder is installed; pass one")
    seeks = len(inspect.signature(decoder).parameters) > 1
    chosen = None if wanted is None else frozenset(wanted)

    def decode(path):
        with opened(path) as f:
            for frame in decoder(f, wanted) if seeks else decoder(f.read()):
                if chosen is None or frame[0] in chosen:
                    yield frame

    return _decoded(videos.select("path"), lambda r: decode(r["path"]), camera_id)


def decode_videos(videos: DataFrame, decoder: Callable[[bytes], Iterator[tuple[int, float, int, int, bytes]]] | None, camera_id: str = "camera") -> DataFrame:
    """Frames of videos (path, content) by a decoder that yields (index, timestamp_ms, height, width, BGR bytes).

    No decoder comes with the library; one is passed in, e.g. around an installed video package. A failing video is a row with an
    error and no frames.
    """
    if decoder is None:
        raise RuntimeError("no video decoder is installed; pass one")
    return _decoded(videos.select("path", "content"), lambda r: decoder(r["content"]), camera_id)


def _decoded(videos: DataFrame, decode: Callable, camera_id: str) -> DataFrame:
    import pyarrow as pa

    names = ["camera_id", "path", "frame_idx", "timestamp_ms", "height", "width", "n_channels", "data", "error"]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    for i, ms, h, w, data in decode(r):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (camera_id, r["path"], i, ms, h, w, 3, data, None), strict=True))], schema=schema)
                except Exception as e:  # noqa: BLE001 - one bad file doesn't end the batch
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (camera_id, r["path"], None, None, None, None, None, None, str(e)), strict=True))], schema=schema)

    kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return videos.mapInArrow(run, "camera_id string, path string, frame_idx int, timestamp_ms double, height int, width int, n_channels int, data binary, error string")
