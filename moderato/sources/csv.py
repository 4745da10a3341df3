"""CSV scans with explicit schemas (S1-S4, S8) and custom-file discovery (S3).

Never ``inferSchema``: every column is declared.  pandas turns a set of
strings (``NA``, ``null``, ``nan`` ...) into missing values when it reads a
CSV; Spark nulls only the empty field, so ``pandas_na`` maps that set to
NULL after the scan to keep the reference's null rules.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderato.functions.labels import category_labels
from moderato.schema import (COMMENT_ROW, CUSTOM_PREFIX, INGEST_COLUMNS, RESERVED_NATIVE_FILES,
                             SOURCE_NATIVE, TEMPLATE_FILE, TEMPLATE_MAX_ROWS)

# The strings pandas' CSV reader treats as missing by default.
PANDAS_NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


class MissingInputError(FileNotFoundError):
    """An input the plan needs does not exist."""


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on any Hadoop file system (local, HDFS, object stores)."""
    p, fs = _fs_path(spark, path)
    return bool(fs.exists(p))


def require_paths(spark: SparkSession, *paths: str) -> None:
    """Stop before planning when an input is absent."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise MissingInputError(f"missing input: {', '.join(missing)}")


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    """Names of the entries of ``directory`` ending in ``suffix`` (bounded: a
    directory listing, not data)."""
    p, fs = _fs_path(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(str(st.getPath().toString()) for st in fs.listStatus(p)
                  if st.getPath().getName().endswith(suffix))


def pandas_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map pandas' default missing-value strings to NULL on string columns."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    na = [s for s in PANDAS_NA_STRINGS if s]
    return df.withColumns({c: F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c)) for c in cols})


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType,
             pandas_na: bool = True, multi_line: bool = True) -> DataFrame:
    """Header CSV with quoted fields and a declared schema.  Fields may hold line ends unless
    ``multi_line`` is off: only then can Spark split a file among tasks."""
    df = (spark.read.schema(schema).option("header", True).option("escape", '"')
          .option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    return pandas_nulls(df) if pandas_na else df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV file (reads its first line only)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def load_split(df: DataFrame, text_col: str = "comment_text") -> DataFrame:
    """NULL text becomes the empty string."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))


def scan_comments(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = COMMENT_ROW,
                  text_col: str = "comment_text", multi_line: bool = True) -> DataFrame:
    """A comment table with a declared schema.  Files that are known to hold no line end inside a
    field are read with ``multi_line=False``, which splits large ones."""
    reader = read_csv(spark, path, schema, multi_line=multi_line) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    return load_split(reader, text_col)


def severity_int(sev: Column) -> Column:
    """``int(severity)`` on a numeric column: truncation toward zero; values
    beyond the INT range stay at its ends."""
    from moderato.operators.validate import severity_number
    num = severity_number(sev)
    return F.when(num.isNotNull(), F.greatest(F.least(num, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int"))


def native_rows(df: DataFrame, source: str | Column = SOURCE_NATIVE, text="text", label="label",
                category="category", severity="severity") -> DataFrame:
    """Annotated rows -> training rows (labels by P4, no English text)."""
    labs = category_labels(F.col(category).cast("string"), severity_int(F.col(severity)),
                           F.col(label).cast("string") == "toxic")
    src = F.lit(source) if isinstance(source, str) else source
    cols = {"comment_text_en": F.lit(""), "comment_text_sn": F.col(text), **labs, "source": src}
    return df.withColumns(cols)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.csv)?/?$", 1)


def decoded_path(uri: Column) -> Column:
    """A URI-encoded path as plain text (a plus sign stands for itself)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def file_checks(df: DataFrame, file_col: str = "_file") -> DataFrame:
    """S3: one row per file, ``(file, name, n_rows, bad_severities, verdict)``: ``reserved`` names, the
    starter ``template`` while it has at most 15 rows, ``bad_severity`` if any severity is not a
    number, else ``kept``.  One small aggregate."""
    bad = F.col("severity").isNull() | severity_int(F.col("severity")).isNull()
    per = df.groupBy(F.col(file_col).alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("bad_severities"))
    name = F.regexp_extract("file", r"([^/]+)/?$", 1)
    verdict = (F.when(name.isin(RESERVED_NATIVE_FILES), F.lit("reserved")).when(F.col("bad_severities") > 0, F.lit("bad_severity"))
               .when((name == TEMPLATE_FILE) & (F.col("n_rows") <= TEMPLATE_MAX_ROWS), F.lit("template")).otherwise(F.lit("kept")))
    return per.select("file", name.alias("name"), "n_rows", "bad_severities", verdict.alias("verdict"))


def custom_rows(df: DataFrame, file_col: str = "_file") -> DataFrame:
    """S3 rules on rows tagged with their file: those of kept files, as training rows with
    ``source = custom_<stem>``.  The per-file check is one small aggregate
    (one row per file); Spark decides whether it is small enough to broadcast."""
    good = file_checks(df, file_col).filter("verdict = 'kept'").select(F.col("file").alias(file_col))
    kept = df.join(good, file_col, "left_semi")
    src = F.concat(F.lit(CUSTOM_PREFIX), file_stem(F.col(file_col)))
    return native_rows(kept, src)


def _header_names(batches):
    for batch in batches:
        names = [next(csv.reader([line.lstrip("\ufeff")]), []) for line in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string()))], names=["path", "header"])


def csv_headers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, header)`` of all files in one distributed scan: of each file only the first
    block is looked at, and of it the first line is kept.  An empty file has no row."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).filter("input_file_block_start() = 0")
    first = lines.select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("_at"))
    first = first.groupBy("path").agg(F.min_by("value", "_at").alias("line"))
    return first.mapInArrow(_header_names, "path string, header array<string>").select(decoded_path(F.col("path")).alias("path"), "header")


class Discovery:
    """Custom files of a folder: ``rows`` (training rows of kept files, None if there is none) and
    ``verdicts``, one row per file (``file, name, header, n_rows, bad_severities, verdict``)."""

    def __init__(self, spark: SparkSession, paths: list[str] | str, file_of: Callable[[Column], Column] | None = None):
        """``file_of`` names the file that a path belongs to (the path itself, if not given)."""
        file_of = file_of or (lambda path: path)
        heads = csv_headers(spark, paths).withColumn("file", file_of(F.col("path")))
        name = F.regexp_extract("file", r"([^/]+)/?$", 1)
        missing = F.size(F.array_except(F.array(*[F.lit(c) for c in INGEST_COLUMNS]), "header")) > 0
        early = F.when(name.isin(RESERVED_NATIVE_FILES), F.lit("reserved")).when(missing, F.lit("missing_columns"))
        # One row per file of a listing.
        found = heads.withColumn("verdict", early).collect()
        shapes: dict[tuple, list[str]] = {}
        for r in found:
            if r.verdict is None:
                shapes.setdefault(tuple(r.header), []).append(r.path)
        parts = []
        for header, files in shapes.items():
            schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
            path = decoded_path(F.input_file_name())
            parts.append(read_csv(spark, files, schema).select(*INGEST_COLUMNS, file_of(path).alias("_file")))
        heads = spark.createDataFrame([(r.file, list(r.header), r.verdict) for r in found], "file string, header array<string>, early string")
        heads = heads.groupBy("file").agg(F.first("header").alias("header"), F.first("early", ignorenulls=True).alias("early"))
        everything = reduce(DataFrame.unionByName, parts) if parts else None
        self.rows = custom_rows(everything) if parts else None
        checks = file_checks(everything) if parts else spark.createDataFrame([], "file string, name string, n_rows long, bad_severities long, verdict string")
        out = heads.join(checks.drop("name"), "file", "left").withColumn("verdict", F.coalesce("early", "verdict", F.lit("empty")))
        self.verdicts = out.select("file", name.alias("name"), "header", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                                   F.coalesce("bad_severities", F.lit(0)).alias("bad_severities"), "verdict")


def discover_custom(spark: SparkSession, directory: str) -> DataFrame | None:
    """S3 over a directory: all ``*.csv`` headers in one scan, files lacking any of the
    four ingest columns dropped, the rest scanned once per distinct header, then
    ``custom_rows``."""
    paths = list_files(spark, directory)
    return Discovery(spark, paths).rows if paths else None


def validate_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A8 for a file: a missing file fails with one ``missing_file`` row;
    otherwise the header decides the columns (all read as strings) and the
    rows go through ``validate_rows``."""
    from moderato.operators.validate import validate_rows
    if not path_exists(spark, path):
        return spark.createDataFrame([("missing_file", "error", 1, path)],
                                     "rule string, level string, n bigint, value string")
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in csv_header(spark, path)])
    return validate_rows(read_csv(spark, path, schema))


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> None:
    """Overwrite the built splits, one directory per split value
    (``partitionBy``), so a reader of one split prunes the others."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
             .option("ignoreTrailingWhiteSpace", False)
    w.format(fmt).save(path)
