"""Readers and writers: quiz CSV, splits, stored artefacts, score table, session log."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.functions.words import LETTERS

TEXT_COLUMNS = ["article", "question", *LETTERS, "answer"]
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TEXT_COLUMNS])
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping: dict[int, list] = {}
_dropping_lock = threading.Lock()
SCORE_SCHEMA = "pipeline string, metric string, value double, run_id string"


class MissingInput(FileNotFoundError):
    """An upstream table is absent; the message names the stage that writes it."""


def read_table(spark: SparkSession, path: str, stage: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a table of an earlier stage or say which stage has to run first."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise MissingInput(f"{path} not found: run the {stage} stage first") from err
        raise


def read_quiz_csv(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """Quiz CSV with header and quoted multi-line articles, fixed schema.

    Columns are matched by header name, so a file may hold them in any order, hold
    others besides, or lack some (those become null).
    """
    try:
        raw = (
            spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("inferSchema", False)
            .csv(path)
        )
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise MissingInput(f"{path} not found: put the raw quiz CSV there first") from err
        raise
    return complete_columns(raw, schema.fieldNames())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, number, record``: the records of quoted CSV files, each file read by as many tasks as it has splits.

    A line begins a record if the quotes in front of it in its file are even in number (a doubled quote counts two).
    Quotes and beginnings are counted by split, summed up over the splits of a file, then line by line inside
    each split; lines of one record are joined again. Both groupings are by parts of bounded size: splits and records.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
            F.monotonically_increasing_id().alias("line"))
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise MissingInput(f"{path} not found: put the raw quiz CSV there first") from err
        raise
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2
    lines = lines.withColumn("odd", odd)
    split, order = W.partitionBy("file", "at"), W.partitionBy("file", "at").orderBy("line")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    inside = lines.withColumn("before", before).withColumn("last", F.max("line").over(split))
    # For either state in front of the split: beginnings in it, and in front of each line.
    counted = inside.groupBy("file", "at").agg(
        (F.sum("odd") % 2).alias("odd"), F.count_if(F.col("before") == 0).alias("even_first"),
        F.count_if(F.col("before") == 1).alias("odd_first"))
    splits = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    states = counted.withColumn("state", F.coalesce(F.sum("odd").over(splits), F.lit(0)) % 2)
    begun = F.when(F.col("state") == 0, F.col("even_first")).otherwise(F.col("odd_first"))
    states = states.withColumn("first", F.coalesce(F.sum(begun).over(splits), F.lit(0))).select(
        "file", "at", "state", "first")
    placed = inside.join(states, ["file", "at"]).withColumn("begins", (F.col("before") == F.col("state")).cast("int"))
    number = F.col("first") + F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line", "value"))), lambda x: x["value"]), "\n")
    return placed.withColumn("number", number).groupBy("file", "number").agg(joined.alias("record")).select(
        "file", "number", F.regexp_replace("record", "\r$", "").alias("record"))


def read_quiz_csv_split(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA,
                        stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows of :func:`read_quiz_csv`, but one large file is many tasks.

    Each file's first record is its header; files of one header are parsed together. Blank records are none."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    records = stage(csv_records(spark, path))
    first = records.where("number = 0").select("file", F.col("record").alias("header"))
    # One row for each way the header is written.
    headers = [r.header for r in first.select("header").distinct().orderBy("header").collect()]
    found = []
    for header in headers:
        width = len(header.split(","))
        kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        names = spark.range(1).select(F.from_csv(F.lit(header), kind.simpleString()[7:-1].replace(":", " "), options).alias("h")).first().h
        named = [(i, n) for i, n in enumerate(names) if n is not None]
        rows = records.join(first.where(F.col("header") == header).select("file"), "file", "left_semi").where(
            (F.col("number") > 0) & F.col("record").rlike(r"[^ \t\r\n]"))
        parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), options)
        made = rows.select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in named])
        found.append(complete_columns(made, schema.fieldNames()).select(*schema.fieldNames()))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def complete_columns(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    """Add absent text columns as null, then turn null text into the empty string."""
    have = set(df.columns)
    rest = [c for c in df.columns if c not in columns]
    filled = [
        F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit("")).alias(c)
        for c in columns
    ]
    return df.select(*rest, *filled)


def with_row_ids(df: DataFrame, columns: list[str] = TEXT_COLUMNS, chunk: int = 10_000) -> DataFrame:
    """Deterministic string ``id``: md5 of the row plus an ordinal among equal rows.

    Equal rows are counted (map-side combine, so a row that makes up a third of the
    table is one counter) and expanded again in chunks that spread over the cluster.
    """
    row_hash = F.md5(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.select(
        *columns,
        row_hash.alias("_h"),
        "_n",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk))).alias("_c"),
    ).repartition("_h", "_c")
    first = F.col("_c") * chunk
    last = F.least(first + chunk, F.col("_n")) - 1
    return chunks.select(
        *columns, "_h", F.explode(F.sequence(first, last)).alias("_k")
    ).select(F.concat_ws(":", "_h", F.col("_k").cast("string")).alias("id"), *columns)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per split under ``path``."""
    writer = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def _hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def outputs_exist(spark: SparkSession, *paths: str) -> bool:
    """True only when every output was written to its end."""
    return all(path_exists(spark, f"{p.rstrip('/')}/_SUCCESS") for p in paths)


def fingerprint(spark: SparkSession, paths: list[str], settings: dict | None = None) -> str:
    """Stamp of inputs and settings: names, sizes and times of all files below the paths, and the settings.

    A path that is absent counts as such; it changes the stamp when it appears."""
    found = []
    for path in sorted(paths):
        fs, p = _hadoop_path(spark, path)
        if not fs.exists(p):
            found.append((path, -1, 0))
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            own = files.next()
            name = own.getPath().toString()
            if not name.rsplit("/", 1)[-1].startswith((".", "_")):
                found.append((name, own.getLen(), own.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found), settings or {}], sort_keys=True).encode()).hexdigest()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled is dropped when the write ends, not when the driver collects its garbage.

    Writes of several threads may overlap: the session's own setting comes back after the last of them."""
    with _dropping_lock:
        held = _dropping.setdefault(id(spark), [0, spark.conf.get(DROP_SHUFFLES, None)])
        held[0] += 1
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _dropping_lock:
            held[0] -= 1
            if not held[0]:
                del _dropping[id(spark)]
                if held[1] is None:
                    spark.conf.unset(DROP_SHUFFLES)
                else:
                    spark.conf.set(DROP_SHUFFLES, held[1])


def write_parquet(df: DataFrame, path: str) -> None:
    """Write a table; its shuffle files go with the write that made them."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)


def materialise(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force: bool = False,
    params: dict | None = None,
    stamp: str | None = None,
) -> DataFrame:
    """Stored table if it is complete and of this ``stamp``, else build and store it.

    The table is written beside its place and moved there when it is whole; its record (stamp, rows, milliseconds, and
    ``params``: settings and scores for :func:`artefact_params`) is written last, so an artefact that was
    broken off, or whose inputs or settings have changed since, is built again.
    """
    if force or not outputs_exist(spark, path) or _stale(spark, path, stamp):
        started = time.monotonic()
        fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        write_parquet(build(), fresh)
        record = {"ms": round(1000 * (time.monotonic() - started))}
        publish(spark, fresh, path)
        # Rows come from the footers of the files; no data is read.
        record["rows"] = spark.read.parquet(path).count()
        save_params(spark, path, params or {}, stamp, record)
    return spark.read.parquet(path)


def publish(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a whole folder in the place of another; the old record goes first."""
    drop_artefact(spark, path)
    fs, target = _hadoop_path(spark, path)
    fs.mkdirs(target.getParent())
    if not fs.rename(_hadoop_path(spark, fresh)[1], target):
        raise OSError(f"cannot move {fresh} to {path}")


def drop_artefact(spark: SparkSession, path: str) -> None:
    """Take away an artefact, its record first."""
    for own in (f"{path}.params", path):
        fs, p = _hadoop_path(spark, own)
        fs.delete(p, True)


def _stale(spark: SparkSession, path: str, stamp: str | None) -> bool:
    return stamp is not None and artefact_record(spark, path).get("stamp") != stamp


def materialise_model(spark: SparkSession, path: str, build, load, force: bool = False, stamp: str | None = None):
    """Like :func:`materialise` for ML models; ``build`` gives ``(model, params)``.

    The record is written last, so its marker vouches for the model too.
    """
    if force or not outputs_exist(spark, f"{path}.params") or _stale(spark, path, stamp):
        started = time.monotonic()
        model, params = build()
        fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        model.write().save(fresh)
        publish(spark, fresh, path)
        save_params(spark, path, params or {}, stamp, {"ms": round(1000 * (time.monotonic() - started))})
        return model, params or {}
    return load(path), artefact_params(spark, path)


def save_params(spark: SparkSession, path: str, params: dict, stamp: str | None = None, run: dict | None = None) -> None:
    """Write the record of an artefact, its marker last."""
    record = json.dumps({"params": params, "stamp": stamp, **(run or {})})
    for name, text in (("record.json", record), ("_SUCCESS", "")):
        fs, p = _hadoop_path(spark, f"{path}.params/{name}")
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def artefact_record(spark: SparkSession, path: str) -> dict:
    """``params, stamp, rows, ms`` of an artefact, or {} without a record."""
    if not outputs_exist(spark, f"{path}.params"):
        return {}
    fs, p = _hadoop_path(spark, f"{path}.params/record.json")
    source = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def artefact_params(spark: SparkSession, path: str) -> dict:
    return artefact_record(spark, path).get("params", {})


def append_scores(scores: DataFrame, path: str, run_id: str) -> None:
    """Add metric rows ``pipeline, metric, value`` of one run."""
    scores.select(
        "pipeline", "metric", F.col("value").cast("double").alias("value"),
        F.lit(run_id).alias("run_id"),
    ).coalesce(1).write.mode("append").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The score table, or an empty one when no run has stored any."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SCORE_SCHEMA)
    return spark.read.schema(SCORE_SCHEMA).parquet(path)


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """Passages ``id, article`` in batch or as files that keep arriving."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("id bigint, article string").format(fmt).load(path)


def write_session_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Session log as CSV with a header."""
    log.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
