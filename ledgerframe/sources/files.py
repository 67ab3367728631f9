"""File scans into content-hashed manifests, and table sinks."""

from __future__ import annotations

import hashlib
import io
import json
import logging
import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.functions import text


def below(path: Column, root: str) -> Column:
    """What of a scanned path comes after root; an error for a path that isn't under it."""
    clean = F.regexp_replace(path, "^file:/+", "/")
    top = root.rstrip("/")
    top = "/" + top[5:].lstrip("/") if top.startswith("file:") else top if "://" in top else os.path.abspath(top)
    return F.when(clean.startswith(top + "/"), F.substring(clean, len(top) + 2, 1 << 20)).otherwise(F.raise_error(F.concat(F.lit(f"not under {top}: "), clean)))


def labelled_files(spark: SparkSession, root: str, classes: tuple[str, ...], source_set: str) -> DataFrame:
    """Images in root/<class>/**: source_id, path, class, subtype, sha256, bytes, extension, source_set. A class that is unknown, or of which there are no files, is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(below(F.col("path"), root).alias("path"), "content", "length").where(text.is_image(F.col("path")))
    parts = F.split("path", "/")
    cls = text.checked_class(F.get(parts, F.lit(0)), classes)
    there = {r[0] for r in rows.select(text.class_name(F.get(parts, F.lit(0))).alias("c")).distinct().limit(len(classes) + 1).collect()}
    if missing := sorted(set(classes) - there):
        raise ValueError(f"no files of class {', '.join(missing)}") if there <= set(classes) else ValueError(f"unknown class: {', '.join(sorted(there - set(classes)))}")
    sub = F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(text.subtype(F.regexp_replace(text.file_name(F.col("path")), r"\.[^.]+$", "")))
    return rows.select(text.stable_id(F.col("path")).alias("source_id"), "path", cls.alias("class"), sub.alias("subtype"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), text.suffix(F.col("path")).alias("extension"), F.lit(source_set).alias("source_set"))


def with_image_size(manifest: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """manifest (path below root) with readable, width and height from an image scan of root; unreadable is 0 by 0."""
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # an image's origin is an encoded URI, a path is not
    sizes = images.select(below(origin, root).alias("_path"), "image.width", "image.height")
    met = manifest.join(sizes, F.col("path") == F.col("_path"), "left")
    ok = F.coalesce(F.col("height") > 0, F.lit(False))
    return met.select(*manifest.columns, ok.alias("readable"), F.when(ok, F.col("width")).otherwise(0).alias("width"), F.when(ok, F.col("height")).otherwise(0).alias("height"))


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """The files under root in order of path: path, bytes, modified, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(below(F.col("path"), root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def inventory(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """expected (path), each once and in order, with exists, bytes, modified and sha256 of what is under root."""
    met = expected.select("path").distinct().join(outputs(spark, root), "path", "left")
    return met.withColumn("exists", F.col("sha256").isNotNull()).orderBy("path")


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all text, nulls as empty text."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns)).fillna("")


def write_table(df: DataFrame, path: str, form: str = "parquet", digits: int | None = None) -> None:
    """Overwrites path. With digits, a CSV's doubles have so many significant ones."""
    if form == "csv" and digits:
        shown = {f.name: text.significant(F.col(f"`{f.name}`"), digits) for f in df.schema if f.dataType.simpleString() in ("double", "float")}
        df = df.withColumns(shown)
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as a row, or a list of them as rows."""
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrites path with a JSON object a row."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A Markdown table of at most `most` rows (more is an error): doubles with `digits` decimals, nulls empty."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table to read")
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_report(spark: SparkSession, path: str, title: str, sections: list[tuple[str, DataFrame | str]], digits: int = 3) -> str:
    """Overwrites path with a Markdown report of headed texts and tables (of at most 1,000 rows each), on any file system that Spark knows; gives its text."""
    parts = [f"# {title}"]
    for head, body in sections:
        parts += [f"## {head}", body if isinstance(body, str) else markdown(body, digits)]
    said = "\n\n".join(parts) + "\n"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(said.encode()))
    finally:
        out.close()
    return said


def tee_logger(name: str, path: str) -> logging.Logger:
    """A logger of the driver that says each line on the screen and, with its time, in a file."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    for handler, form in ((logging.StreamHandler(), "%(message)s"), (logging.FileHandler(path, encoding="utf-8"), "%(asctime)s %(levelname)s %(message)s")):
        handler.setFormatter(logging.Formatter(form))
        logger.addHandler(handler)
    return logger


def cached(spark: SparkSession, top: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key under top: read if it was written whole, else made and written. top must be a folder that all machines share."""
    path = f"{top.rstrip('/')}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:24]}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def complete_parts(spark: SparkSession, pattern: str, schema: str, key: str, wanted: list) -> DataFrame:
    """The union of the CSV files that match; an error unless `key` takes just the wanted values."""
    parts = spark.read.csv(pattern, header=True, schema=schema)
    there = {r[0] for r in parts.select(key).distinct().limit(len(wanted) + 1).collect()}
    if missing := [w for w in wanted if w not in there]:
        raise ValueError(f"missing {key}: {', '.join(map(str, missing))}")
    if extra := sorted(map(str, there - set(wanted))):
        raise ValueError(f"unexpected {key}: {', '.join(extra)}")
    return parts


def zip_members(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A row for each member of the ZIP files at path whose name has the prefix: path, member, bytes, sha256; a file that is no ZIP has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [{"path": name, "member": i.filename, "bytes": i.file_size, "sha256": _digest(z, i)} for i in z.infolist() if i.filename.startswith(prefix) and not i.is_dir()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, bytes long, sha256 string")


def _digest(z: zipfile.ZipFile, member: zipfile.ZipInfo) -> str:
    with z.open(member) as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


# What an upload may be.
MOST_BYTES, LEAST_SIDE, MOST_PIXELS = 10 * 1024 * 1024, 32, 30_000_000


def upload_problem(size: Column, width: Column, height: Column) -> Column:
    """Why an uploaded image is refused; null if it is not."""
    return (
        F.when(size == 0, "empty")
        .when(size > MOST_BYTES, "too large")
        .when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "unreadable")
        .when(F.least(width, height) < LEAST_SIDE, "too small")
        .when(width.cast("long") * height > MOST_PIXELS, "too many pixels")
    )
