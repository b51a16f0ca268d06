"""Sources and sinks.

Monthly case extracts are CSV files whose list order is recency order.  Every
file is read by its own header (all columns as strings, quoted newlines
allowed): files with equal headers in one scan, the scans stacked by name.  A
file's position comes from its full path, the row order inside the file from
``monotonically_increasing_id`` (a multi-line CSV file is not split, so ids
rise in file order).  Rows one field short get the reference's repair: an
empty value inserted at position 20, later values shifted right; any other row
of a wrong width is kept and named in ``record_status``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records import read_records

CORRUPT = "_corrupt_record"
# Quoted empty fields read as "", unquoted empty and missing ones as null.
_MISSING = "\u0000<missing>\u0000"
GENDER_POSITION = 20


def _csv(spark: SparkSession, schema: StructType | None = None):
    r = (spark.read.format("csv").option("header", True).option("multiLine", True).option("escape", '"')
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
         .option("nullValue", _MISSING).option("emptyValue", ""))
    return r.schema(schema) if schema is not None else r


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line of one file."""
    return spark.read.option("header", True).csv(path).columns


def repair_shift(df: DataFrame, cols: list[str], at: int | None = GENDER_POSITION) -> DataFrame:
    """A2: a record that is exactly one field short gets an empty value at
    ``at``; the values from there on move one column to the right.

    Adds ``was_repaired`` and ``record_status``: ok, repaired, short (fields
    are missing, the last columns are null) or long (more fields than the
    header has; the raw record is in ``record_text``)."""
    n = len(cols)
    bad = F.col(CORRUPT).isNotNull()
    short = F.lit(False)
    if at is not None and 2 <= n and at < n:
        short = bad & F.col(cols[n - 1]).isNull() & F.col(cols[n - 2]).isNotNull()
    fixed = []
    for i, c in enumerate(cols):
        x = F.col(c)
        if at is not None and i == at < n:
            x = F.when(short, F.lit("")).otherwise(x).alias(c)
        elif at is not None and i > at:
            x = F.when(short, F.col(cols[i - 1])).otherwise(x).alias(c)
        fixed.append(x)
    status = (F.when(~bad, "ok").when(short, "repaired")
              .when(F.col(cols[n - 1]).isNull(), "short").otherwise("long"))
    rest = [c for c in df.columns if c not in cols and c != CORRUPT]
    return df.select(*fixed, *rest, short.alias("was_repaired"), status.alias("record_status"),
                     F.when(bad & ~short, F.col(CORRUPT)).alias("record_text"))


_SLASHES = "^([A-Za-z0-9+.-]+):/+"  # schemes are written with one slash or three


def _uri(spark: SparkSession, path: str) -> str:
    """The path as ``_metadata.file_path`` writes it, with one slash after the scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(_SLASHES, r"\1:/", fs.makeQualified(p).toUri().toString())


def _parsed(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    """The rows of files with one header, their records found by many tasks and parsed as ``_csv`` does."""
    records = read_records(spark, paths).where("at > 0")  # the first record is the header
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "nullValue": _MISSING, "emptyValue": "",
               "multiLine": "true"}
    fields = F.from_csv(F.regexp_replace("record", "\r$", ""), schema.toDDL(), options)
    return records.select(fields.alias("r"), F.regexp_replace("path", _SLASHES, "$1:/").alias("source_path"),
                          F.col("at").alias("row_seq")).select("r.*", "source_path", "row_seq")


def read_monthly(spark: SparkSession, paths: list[str], repair_at: int | None = GENDER_POSITION, many_tasks: bool = False) -> DataFrame:
    """A1 (+A2): ordered multi-file load, each file by its own header,
    stacked by name (a column that a file lacks is null); adds ``file_seq``
    (1-based position in ``paths``), ``row_seq`` (order inside the file),
    ``source_path`` and the status columns of ``repair_shift``.

    ``many_tasks`` cuts large files into blocks that are read at the same
    time (``records.py``); otherwise a file is one task, as its values may hold
    line ends."""
    if not paths:
        raise FileNotFoundError("no input files")
    by_header: dict[tuple, list[tuple[int, str]]] = {}
    for i, p in enumerate(paths):
        by_header.setdefault(tuple(header_of(spark, p)), []).append((i + 1, p))
    out = None
    for cols, files in by_header.items():
        schema = StructType([StructField(c, StringType()) for c in (*cols, CORRUPT)])
        # the list of files is the caller's, one small row each
        seq = spark.createDataFrame([(_uri(spark, p), i) for i, p in files], "source_path string, file_seq int")
        if many_tasks:
            df = _parsed(spark, schema, [p for _, p in files])
        else:
            df = (_csv(spark, schema).load([p for _, p in files])
                  .withColumn("source_path", F.regexp_replace(F.col("_metadata.file_path"), _SLASHES, "$1:/"))
                  .withColumn("row_seq", F.monotonically_increasing_id()))
        df = repair_shift(df.join(F.broadcast(seq), "source_path").select(*df.columns, "file_seq"), list(cols), repair_at)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def list_csv(spark: SparkSession, directory: str) -> list[str]:
    """A3 file listing: *.csv and *.CSV, sorted by name (Hadoop FS API, so
    it works on any cluster file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(directory)
    fs = p.getFileSystem(conf)
    names = [s.getPath().toString() for s in fs.listStatus(p)
             if s.isFile() and s.getPath().getName().lower().endswith(".csv")]
    return sorted(names, key=lambda x: x.rsplit("/", 1)[-1])


def read_glob(spark: SparkSession, directory: str, repair_at: int | None = None) -> DataFrame:
    """A3: every CSV in a folder, in name order; error when there is none."""
    paths = list_csv(spark, directory)
    if not paths:
        raise FileNotFoundError(f"no CSV files in {directory}")
    return read_monthly(spark, paths, repair_at)


def with_source_file(df: DataFrame) -> DataFrame:
    """A4: lineage column with the source file name."""
    if "source_path" in df.columns:
        name = F.element_at(F.split("source_path", "/"), -1)
        return df.withColumn("source_file", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def read_cases(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | None = None) -> DataFrame:
    """A5: one case table; CSV with header (explicit schema preferred,
    inference only for exploration)."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table (CSV with header, no index)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def export_predictions(predictions: DataFrame, coefficients: DataFrame, path: str,
                       fmt: str = "csv") -> None:
    """The reference's two-section file as two tables."""
    write_table(predictions, f"{path.rstrip('/')}/predictions", fmt)
    write_table(coefficients, f"{path.rstrip('/')}/coefficients", fmt)


CASE_FORM_SCHEMA = StructType([StructField(c, StringType()) for c in (
    "case_id", "case_summary", "channel", "case_type", "category", "plan_tier")] +
    [StructField("customer_tenure_months", StringType())])


def cases_from_rows(spark: SparkSession, rows: list[dict], schema: StructType = CASE_FORM_SCHEMA) -> DataFrame:
    """Case rows from form values (strings; typed by the cleaning step)."""
    return spark.createDataFrame([tuple(None if r.get(f.name) is None else str(r.get(f.name))
                                        for f in schema.fields) for r in rows], schema)


def spread(spark: SparkSession, df: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """Hash-partition a scan that has fewer splits than the cluster has
    cores, so CPU-bound per-row work (tokenising long texts) runs on every
    core instead of the one task that owns a large row group.

    The shuffle is bounded: a scan with fewer splits than cores holds at
    most ``cores x spark.sql.files.maxPartitionBytes``.  A large table
    already has more splits than cores, and then nothing changes (no
    shuffle).  Hashing on ``key`` keeps the placement deterministic, so a
    retried task reads the same rows."""
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, key)
