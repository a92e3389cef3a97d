"""Readers and writers of the files around a run."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.text import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension, file_type
from framelake.operators.selection import first_per_key

MANIFEST = T.StructType([T.StructField(n, t()) for n, t in (("file_path", T.StringType), ("file_type", T.StringType), ("extension", T.StringType), ("size_bytes", T.LongType), ("hash", T.StringType), ("is_duplicate", T.BooleanType), ("canonical_path", T.StringType), ("duration_s", T.DoubleType), ("is_long_video", T.BooleanType), ("sample_windows_s", T.StringType), ("run_name", T.StringType), ("scanned_at", T.TimestampNTZType))])
STATUS = T.StructType([T.StructField(n, t()) for n, t in (("file_path", T.StringType), ("status", T.StringType), ("keepers", T.IntegerType), ("elapsed_s", T.DoubleType), ("processed_at", T.TimestampNTZType))])


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run; anything missing has its default."""

    name: str = "run"
    long_video_threshold_s: float = 60.0
    long_video_windows: int = 20
    long_video_min_spacing_s: int = 5
    output_dir: str = "data"

    @classmethod
    def load(cls, path: str) -> RunConfig:
        import yaml

        with open(path) as f:
            got = yaml.safe_load(f) or {}
        return cls(**{x.name: got[x.name] for x in fields(cls) if got.get(x.name) is not None})


def folder_list(spark: SparkSession, path: str) -> DataFrame:
    """(dir): lines of a list, trimmed, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("dir")).filter((F.col("dir") != "") & ~F.col("dir").startswith("#"))


def crawl(spark: SparkSession, folders: list[str], content: bool = False) -> DataFrame:
    """Media files below folders: path, file_type, extension, size_bytes, modified, and content where asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    f = f.filter(extension(F.col("path")).isin(*VIDEO_EXTENSIONS, *IMAGE_EXTENSIONS))
    cols = [F.col("path").alias("file_path"), file_type(F.col("path")).alias("file_type"), extension(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    return f.select(*cols, *(["content"] if content else []))


def new_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    return found.dropDuplicates(["file_path"]).join(manifest.select("file_path").distinct(), "file_path", "left_anti")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with header; arrays as JSON text."""
    cols = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines, the last line of a key wins. Blank lines and, unless strict, malformed ones are skipped."""
    line = spark.read.text(path).select("value", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_n")).filter(F.trim("value") != "")
    if strict:
        return line.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    rows = line.select(F.from_json("value", schema).alias("r"), "_f", "_n").select("r.*", "_f", "_n").filter(F.col(key).isNotNull())
    return first_per_key(rows, [key], [F.desc("_f"), F.desc("_n")]).drop("_f", "_n")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of many lines; what is missing or cannot be read gives no rows."""
    if not os.path.exists(path.removeprefix("file://")) and "://" not in path:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_document(obj: object, path: str, spark: SparkSession | None = None) -> None:
    """A small JSON document, replaced as a whole: written beside the old one, then renamed over it.

    With a session the path may be on any file system that Spark knows.
    """
    text = json.dumps(obj)
    if spark is None:
        with open(path + ".part", "w") as f:
            f.write(text)
        os.replace(path + ".part", path)
        return
    jvm = spark.sparkContext._jvm
    to, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = to.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(part, to, _overwrite(spark))


def _overwrite(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    return options


def write_version(df: DataFrame, root: str) -> str:
    """A table written beside its former versions; readers take it once it is complete."""
    from framelake.streaming.incremental import _versions

    n = 1 + max(_versions(df.sparkSession, root), default=-1)
    df.write.mode("overwrite").parquet(f"{root}/v={n}")
    return f"{root}/v={n}"


def unique_names(df: DataFrame, path: str, order: list[Column]) -> DataFrame:
    """``export_name``: the file's name, from the second of a name on with _2, _3 ... before the extension."""
    from pyspark.sql import Window

    from framelake.functions.text import basename

    d = df.withColumn("_b", basename(F.col(path)))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    stem, ext = F.regexp_replace("_b", r"\.[^.]*$", ""), F.regexp_extract("_b", r"(\.[^.]*)$", 1)
    return d.withColumn("export_name", F.when(F.col("_n") > 1, F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext)).otherwise(F.col("_b"))).drop("_b", "_n")


def with_optional(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """A column that older files lack, with its default."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))
