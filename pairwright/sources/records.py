"""Reading and writing record streams: JSON lines, tables, reports and templates."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.operators.validate import typed

def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder, so that later reads see the same rows."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


RECORD_FILE = r"/((?:jobs|resumes|pairs)_[^/]*\.jsonl)(?:/[^/]*)?$"


def _store(spark: SparkSession, path: str):
    """(path, store) of Hadoop's for a path in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def record_files(spark: SparkSession, folder: str) -> list[str]:
    """The jobs_, resumes_ and pairs_ .jsonl files under a folder, by listing alone; hidden ones are left out."""
    at, fs = _store(spark, folder)
    found = []
    if fs.exists(at):
        files = fs.listFiles(at, True)
        while files.hasNext():
            path = files.next().getPath().toString()
            if re.search(RECORD_FILE, path) and not re.search(r"/[._][^/]*$", path):
                found.append(path)
    return sorted(found)


def record_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(record_type, source_file, file_path, line_number, value) of the non-blank lines of jobs_, resumes_ and pairs_ files.

    Blank lines count in the number. Other files aren't read; none at all is an error. A line's id within its part of a
    file is what Spark's id counts from the part's first line on. The parts are counted by one reading that takes no text,
    and their first ids and the lines before them are joined to a second reading of the same parts, so a large file is read
    by many tasks and no text is copied. Files must not change between the two.
    """
    paths = record_files(spark, folder)
    if not paths:
        raise FileNotFoundError(f"no jobs_, resumes_ or pairs_ .jsonl files in {folder}")
    rows = spark.read.text([re.sub(r"([*?{}\[\]\\])", r"\\\1", p) for p in paths])
    part = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block")]
    blocks = settled(rows.select(*part, F.monotonically_increasing_id().alias("id")).groupBy("file_path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = settled(blocks.select("file_path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    begins = F.broadcast(begins) if begins.count() <= 100_000 else begins
    numbered = rows.select("value", *part, F.monotonically_increasing_id().alias("id")).join(begins, ["file_path", "block"])
    source = F.regexp_extract("file_path", RECORD_FILE, 1)
    return numbered.where(F.col("value").rlike(r"\S")).select(F.substring_index(source, "_", 1).alias("record_type"), source.alias("source_file"), "file_path", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_number"), "value")


def document_records(spark: SparkSession, path: str, kind: str = "pairs") -> DataFrame:
    """(record_type, source_file, line_number, value) of the records of one kind in documents of the form {"records": {kind: [...]}}.

    That is how validated data are handed over as one document. line_number is the record's place in its document, from 1. A
    document is parsed by one task; its records are dealt out again after that. A document without records has no rows.
    """
    schema = f"records struct<`{kind}`: array<string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("source_file"), F.posexplode(F.col("records")[kind]).alias("at", "value"))
    return each.repartition("source_file", F.col("at") % 1024).select(F.lit(kind).alias("record_type"), "source_file", (F.col("at") + 1).cast("long").alias("line_number"), "value")


def typed_pairs(lines: DataFrame, now: str | None = None) -> DataFrame:
    """Pairs from valid lines (value), typed by the validator's own readings, with their defaults; see ``typed``."""
    rows = typed(lines, "pairs", now)
    return rows.select(*(c for c in lines.columns if c != "value"), "record.*")


def strict_pairs(checked: DataFrame) -> DataFrame:
    """Pairs of validated lines; if any is invalid an error names the first by file and line, before a pair is returned."""
    rows = checked.where("record_type = 'pairs'")
    where = F.struct("source_file", *(["file_path"] if "file_path" in rows.columns else []), "line_number")
    first = rows.where("error_count > 0").agg(F.min(where).alias("x")).collect()[0]["x"]
    if first is not None:
        raise ValueError(f"invalid record in {first['source_file']} line {first['line_number']}")
    return typed_pairs(rows.select("source_file", "line_number", "value"))


MANIFEST = "_MANIFEST.json"


def write_records(df: DataFrame, folder: str, run_ts: str, form: str = "parquet") -> str:
    """Writes one run of a record stream under its stamp, and then its manifest, which tells that the run is complete."""
    path = f"{folder}/run_ts={run_ts}"
    df.write.format(form).save(path)
    at, fs = _store(df.sparkSession, f"{path}/{MANIFEST}")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"run_ts": run_ts, "form": form, "schema": df.schema.jsonValue()}).encode()))
    out.close()
    return path


def complete_runs(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The manifests of all complete runs by stamp, in order; found by listing, no row is read."""
    at, fs = _store(spark, f"{folder}/run_ts=*/{MANIFEST}")
    found = {}
    for status in fs.globStatus(at) or []:
        stream = fs.open(status.getPath())
        told = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        found[told["run_ts"]] = told
    return dict(sorted(found.items()))


def missing_inputs(spark: SparkSession, patterns: dict[str, str]) -> None:
    """Raises one error that names all inputs of which no file fits its pattern."""
    conf = spark._jsc.hadoopConfiguration()
    absent = []
    for name, pattern in patterns.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        if not path.getFileSystem(conf).globStatus(path):
            absent.append(name)
    if absent:
        raise FileNotFoundError("missing inputs: " + ", ".join(absent))


def latest(spark: SparkSession, folder: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """The rows of the complete run with the highest stamp, with run_ts; a folder without a complete run is an error that
    names it.

    A run without a manifest is unfinished and doesn't count. Only the run that is returned is read; its schema is
    ``schema`` or the manifest's.
    """
    missing_inputs(spark, {folder: f"{folder}/run_ts=*/{MANIFEST}"})
    stamp, told = list(complete_runs(spark, folder).items())[-1]
    rows = spark.read.schema(schema or StructType.fromJson(told["schema"])).format(told.get("form", form)).load(f"{folder}/run_ts={stamp}")
    return rows.withColumn("run_ts", F.lit(stamp))


def write_report(df: DataFrame, path: str) -> None:
    """A report-sized table as one CSV file."""
    df.coalesce(1).write.option("header", True).csv(path)


def template_ids(registry: DataFrame, kind: str, active_only: bool = True) -> DataFrame:
    """Ids of a kind, sorted; a template without an active flag is active."""
    rows = registry.where(F.col("kind") == kind)
    return (rows.where(F.coalesce("active", F.lit(True))) if active_only else rows).select("template_id").orderBy("template_id")


def with_template(rows: DataFrame, registry: DataFrame, key: str = "template_id") -> DataFrame:
    """Adds the template's text; an unknown id is an error."""
    known = registry.select(F.col("template_id").alias(key), F.col("text").alias("template"))
    joined = rows.join(known, key, "left")
    return joined.withColumn("template", F.when(F.col("template").isNull(), F.raise_error(F.concat(F.lit("unknown template id "), F.coalesce(key, F.lit("null"))))).otherwise(F.col("template")))
