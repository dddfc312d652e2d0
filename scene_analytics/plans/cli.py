"""python -m scene_analytics.plans.cli demo|curate|mask|batch ..."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import cameras as cams
from ..operators.clusters import AnalysisConfig
from ..operators.errors import AnalysisError
from ..operators.lineage import numbered
from ..sources import config, embeddings, frames, video
from . import curation, mask_jobs
from .progress import Job


def parser() -> argparse.ArgumentParser:
    # Flag names and defaults are fixed values.
    p = argparse.ArgumentParser(description="Scene analytics jobs")
    jobs = p.add_subparsers(dest="job", required=True)
    for name in ("demo", "curate"):
        c = jobs.add_parser(name)
        c.add_argument("--n-samples", type=int, default=500)
        if name == "curate":
            source = c.add_mutually_exclusive_group(required=True)
            source.add_argument("--embeddings", help="Parquet with vec_id, embedding and maybe path")
            source.add_argument("--video-dir", help="folder of videos, at any depth; takes --encoder")
            source.add_argument("--frame-dir", help="folder of folders of frames; takes --encoder")
            c.add_argument("--frame-pattern", default="**/CMR_GT_Frame", help="glob of the frame folders below --frame-dir")
            c.add_argument("--encoder", help="module:function that loads an encoder of [path, image paths]; image paths are null for videos")
        c.add_argument("--k-neighbors", type=int, default=15)
        c.add_argument("--resolution", type=float, default=1.0)
        c.add_argument("--output-dir", default="output")
        c.add_argument("--skip-clustering", action="store_true")
    m = jobs.add_parser("mask")
    m.add_argument("--input", "-i", required=True, help="folder of images, or a video")
    m.add_argument("--camera", default="camera")
    b = jobs.add_parser("batch")
    b.add_argument("--input-dir", required=True, help="folder of videos and of folders of images, one for each recording")
    for j in (m, b):
        j.add_argument("--output", "-o", default="./output")
        j.add_argument("--config", "-c")
        j.add_argument("--threshold", "-t", type=float, default=50.0)
        j.add_argument("--samples", "-n", type=int, default=100)
        j.add_argument("--no-vignetting", action="store_true")
        j.add_argument("--save-intermediate", action="store_true")
        j.add_argument("--verbose", action="store_true")
        j.add_argument("--decoder", help="module:function that decodes a video's bytes, see sources.frames.decode_videos")
    return p


def plugged(name: str | None) -> Callable | None:
    """The function that module:function names."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def stem_of(path: str) -> str:
    return PurePosixPath(path).stem


def run_mask(spark: SparkSession, a: argparse.Namespace) -> int:
    """The mask of one folder of images or video, in files named by it; 0, or 1 if it fails, which is reported."""
    try:
        cameras, whole = config.load(spark, a.config)
        known = cameras.where(cameras["camera_id"] == a.camera)
        seen = video.metadata(spark.createDataFrame([(a.input,)], "path string")).first() if frames.is_video(a.input) else None
        if a.verbose and seen is not None and seen.error is None:
            print(f"{stem_of(a.input)}: {seen.frame_count} frames of {seen.width} x {seen.height}")
        n = mask_jobs.sample_count(whole, a.samples)
        source = frames.sampled_source(spark, a.input, not frames.is_video(a.input), n, plugged(a.decoder), a.camera)
        found = mask_jobs.single(spark, source, None if known.isEmpty() else known, whole, n, a.threshold, not a.no_vignetting, sampled=True)
        mask_jobs.save(found, a.output, a.save_intermediate, stem_of(a.input))
        return 0
    except (AnalysisError, config.ConfigError, PySparkException, RuntimeError, OSError) as e:
        print(f"{a.input} failed: {e}")
        return 1


def run_batch(spark: SparkSession, a: argparse.Namespace, progress: Callable[[int, int, str], None] | None = None, job: Job | None = None) -> int:
    """Masks of every recording in a folder, each below its own name; 1 if there is none or one fails, else 0.

    Recordings are the videos right in the folder and the folders of images below it. A recording's camera is the first configured
    one whose id is in its name, or else the first one. A recording that fails is reported and counted, and the others go on.
    `progress` hears (done, all, name) after each. A cancelled `job` ends the batch: recordings that aren't done are counted as failed.
    """
    try:
        files = frames.paths(spark, a.input_dir)
        videos = frames.discover_batch(files, frames.qualified(spark, a.input_dir)).select(F.col("path").alias("file_path"))
        found = videos.unionByName(frames.image_folders(spark, a.input_dir))
        cameras, whole = config.load(spark, a.config)
        matched = cams.with_fallback(cams.match(found, cameras), cameras).orderBy("file_path").collect()
    except AnalysisException as e:
        print(f"{a.input_dir} can't be read: {e.getCondition()}")
        return 1
    if not matched:
        print(f"no folder of images and no video in {a.input_dir}")
        return 1
    failed = 0
    for done, r in enumerate(matched, 1):
        if job is not None and job.cancelled:
            print(f"cancelled before {r.file_path}")
            failed += len(matched) - done + 1
            break
        name = stem_of(r.file_path) if frames.is_video(r.file_path) else PurePosixPath(r.file_path).name
        if a.verbose:
            print(f"{name}: camera {r.camera_id}")
        try:
            n = mask_jobs.sample_count(whole, a.samples)
            source = frames.sampled_source(spark, r.file_path, not frames.is_video(r.file_path), n, plugged(a.decoder), r.camera_id or name)
            own = None if r.camera_id is None else cameras.where(cameras["camera_id"] == r.camera_id)
            mask_jobs.save(mask_jobs.single(spark, source, own, whole, n, a.threshold, not a.no_vignetting, sampled=True), f"{a.output}/{name}", a.save_intermediate)
        except (AnalysisError, PySparkException, RuntimeError, OSError) as e:
            print(f"{name} failed: {e}")
            failed += 1
        if progress is not None:
            progress(done, len(matched), name)
    print(f"{len(matched) - failed} done, {failed} failed")
    return 1 if failed else 0


def clips(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(vec_id, path, images) of the videos of --video-dir, or of the frame folders of --frame-dir, which are named by session."""
    if a.video_dir:
        found = frames.discover_videos(frames.paths(spark, a.video_dir)).withColumn("images", F.lit(None).cast("array<string>"))
        return numbered(found, "vec_id", "path").select("vec_id", "path", "images")
    files = frames.paths(spark, a.frame_dir)
    folders = frames.discover_frame_folders(files, a.frame_pattern, frames.qualified(spark, a.frame_dir))
    images = frames.frame_folder_images(files).groupBy("frame_dir").agg(F.sort_array(F.collect_list("path")).alias("images"))
    found = folders.join(images, "frame_dir", "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    return numbered(found, "vec_id", "frame_dir").select("vec_id", names.session_name(F.col("frame_dir")).alias("path"), "images")


def run_curation(spark: SparkSession, a: argparse.Namespace) -> int:
    """Embeddings, made or read, saved, and unless there are too few the report on their clusters; 1 if nothing is found."""
    truth = None
    if a.job == "demo":
        df = embeddings.synthetic(spark, n=a.n_samples, clusters=12)
        truth = df.select("vec_id", "label")
    elif a.embeddings:
        df = spark.read.parquet(a.embeddings)
    else:
        if a.encoder is None:
            print("--video-dir and --frame-dir take --encoder")
            return 1
        found = clips(spark, a)
        if found.isEmpty():
            print(f"nothing to encode in {a.video_dir or a.frame_dir}")
            return 1
        encoded = embeddings.encode(found, plugged(a.encoder), ["path", "images"]).persist()
        done, failed = curation.tally(encoded)
        print(f"{done} encoded, {failed} failed")
        if not done:
            return 1
        df = encoded.where("error is null").select("vec_id", "path", "embedding")
    embeddings.save(df, f"{a.output_dir}/embeddings")
    if a.skip_clustering or not curation.worth_clustering(df):
        return 0
    cfg = curation.CurationConfig(curation.ClusteringConfig(k_neighbors=a.k_neighbors, resolution=a.resolution), AnalysisConfig(low_density_percentile=15.0))
    result = curation.run_from_embeddings(df, cfg)
    for r in curation.summarize(result).select("line").collect():
        print(r.line)
    if truth is not None:
        curation.quality(result.labels, truth).show()
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    return {"batch": run_batch, "mask": run_mask}.get(a.job, run_curation)(spark, a)


if __name__ == "__main__":
    raise SystemExit(main())
