"""Camera configuration from YAML, as a table with all defaults filled in."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGION = "struct<name:string,description:string,x:int,y:int,width:int,height:int>"
SCHEMA = f"camera_id string, cfg_order int, type string, resolution struct<w:int,h:int>, has_vignetting boolean, vignetting_config struct<threshold:double,margin:int>, regions array<{REGION}>"
GLOBAL_SCHEMA = "default_resolution struct<w:int,h:int>, frame_sample_count int, variance_threshold double, morphology_kernel_size int"


class ConfigError(ValueError):
    pass


def parse(text: str | None) -> tuple[list[tuple], tuple]:
    """Rows of cameras and the global row. No text: no cameras and the defaults; an empty document is an error."""
    import yaml

    tree = {} if text is None else yaml.safe_load(text)
    if not isinstance(tree, dict):
        raise ConfigError("the configuration is empty or not a mapping")
    cameras = []
    for order, (name, c) in enumerate((tree.get("cameras") or {}).items()):
        c = c or {}
        regions = []
        for r in c.get("expected_ego_regions") or []:
            box = ([int(v) for v in r.get("hint_roi") or []] + [0] * 4)[:4]
            regions.append((r.get("name", ""), r.get("description", ""), *box))
        v = c.get("vignetting_config")
        vignetting = None if v is None else (float(v.get("threshold", 0.7)), int(v.get("margin", 50)))
        cameras.append((str(name), order, c.get("type", "narrow"), tuple(c.get("resolution", (1920, 1080))), bool(c.get("has_vignetting", False)), vignetting, regions))
    g = tree.get("global") or {}
    whole = (tuple(g.get("default_resolution", (1920, 1080))), int(g.get("frame_sample_count", 100)), float(g.get("variance_threshold", 50.0)), int(g.get("morphology_kernel_size", 5)))
    return cameras, whole


def load(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame]:
    """(cameras, global settings). A missing file gives the defaults."""
    text = Path(path).read_text(encoding="utf-8") if path and Path(path).exists() else None
    cameras, whole = parse(text)
    return spark.createDataFrame(cameras, SCHEMA), spark.createDataFrame([whole], GLOBAL_SCHEMA)


def read_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of `documents`, and cameras (an array), global and error of each configuration in `text`.

    A null text gives the defaults; one that can't be read has its error and nothing else, and ends no job.
    """
    import pyarrow as pa

    keep = [c for c in documents.columns if c != text]
    names = ["camera_id", "cfg_order", "type", "resolution", "has_vignetting", "vignetting_config", "regions"]
    box, pair = ["name", "description", "x", "y", "width", "height"], ["w", "h"]
    size = pa.struct([("w", pa.int32()), ("h", pa.int32())])
    region = pa.struct([("name", pa.string()), ("description", pa.string()), *[(c, pa.int32()) for c in box[2:]]])
    limits = pa.struct([("threshold", pa.float64()), ("margin", pa.int32())])
    camera = pa.struct(list(zip(names, [pa.string(), pa.int32(), pa.string(), size, pa.bool_(), limits, pa.list_(region)], strict=True)))
    whole = pa.struct([("default_resolution", size), ("frame_sample_count", pa.int32()), ("variance_threshold", pa.float64()), ("morphology_kernel_size", pa.int32())])
    named = lambda keys, values: None if values is None else dict(zip(keys, values, strict=True))

    def told(row):
        c = named(names, row)
        return c | {"resolution": named(pair, c["resolution"]), "vignetting_config": named(["threshold", "margin"], c["vignetting_config"]), "regions": [named(box, r) for r in c["regions"]]}

    def run(batches):
        import yaml

        for b in batches:
            cameras, settings, errors = [], [], []
            for document in b.column(len(keep)).to_pylist():
                try:
                    rows, g = parse(document)
                    cameras.append([told(r) for r in rows])
                    settings.append(named([f.name for f in whole], (named(pair, g[0]), *g[1:])))
                    errors.append(None)
                except (ValueError, TypeError, AttributeError, yaml.YAMLError) as e:
                    cameras.append(None)
                    settings.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(cameras, pa.list_(camera)), pa.array(settings, whole), pa.array(errors, pa.string())], names=[*keep, "cameras", "global", "error"])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    fields = ", ".join(f"{k}: {v}" for k, v in (x.split(" ", 1) for x in GLOBAL_SCHEMA.split(", ")))
    inner = "camera_id: string, cfg_order: int, type: string, resolution: struct<w:int,h:int>, has_vignetting: boolean, vignetting_config: struct<threshold:double,margin:int>, regions: array<" + REGION + ">"
    return documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, ", ".join([*kinds, f"cameras array<struct<{inner}>>", f"global struct<{fields}>", "error string"]))


def cameras_of(read: DataFrame) -> DataFrame:
    """A row for each camera of `read_documents`, behind the documents' own columns."""
    own = [c for c in read.columns if c not in ("cameras", "global", "error")]
    return read.select(*own, F.explode("cameras").alias("__c")).select(*own, "__c.*")


def globals_of(read: DataFrame) -> DataFrame:
    """A row of global settings for each document that could be read."""
    own = [c for c in read.columns if c not in ("cameras", "global", "error")]
    return read.where("error is null").select(*own, "global.*")
