"""File sources: CSV and parquet scans, folder listings, size guard, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.meta import row_hash
from feedloom.types import col

# Texts that mean "missing" in a CSV cell.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Largest payload read as one file, in bytes.
MAX_FILE_BYTES = 25_000_000

FORMATS = {".xlsx": "excel", ".xlsm": "excel", ".csv": "csv", ".parquet": "parquet"}


def infer_format(name: str | None, declared: str | None = None) -> str:
    """Declared format, else by file extension, else ``excel``."""
    if declared and declared.lower() in ("excel", "csv", "parquet"):
        return declared.lower()
    lowered = (name or "").lower()
    return next((kind for ending, kind in FORMATS.items() if lowered.endswith(ending)), "excel")


def _null_tokens(c: Column) -> Column:
    return F.when(~c.isin(list(NULL_TOKENS)), c)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | None = None,
    *,
    infer: bool = True,
    recursive: bool = False,
    multi_line: bool = False,
    pattern: str | None = None,
    bad_rows: str = "fail",
) -> DataFrame:
    """CSV with a header row; null tokens become NULL before types are decided.

    With ``schema`` (DDL) there is one pass and bad cells fail the job. Without
    it every column is read as text and the narrowest type that all its cells
    fit is found by one aggregate over the file. ``multi_line`` allows line
    breaks inside quotes; such files cannot be split among tasks. ``path`` may be a
    folder or a glob, ``pattern`` filters its file names.

    A row with too few or too many cells, or with a line break inside quotes that ``multi_line``
    does not allow, fails the job; with ``bad_rows="skip"`` it is left out, and
    :func:`csv_rejects` returns it.
    """
    if bad_rows not in ("fail", "skip"):
        raise ValueError(f"bad_rows must be fail or skip, not {bad_rows!r}")
    raw = _csv_rows(spark, path, recursive, multi_line, pattern)
    if bad_rows == "skip":
        raw = raw.where(F.coalesce(F.length(col(REJECT)), F.lit(-1)) < 0).drop(REJECT)
    else:
        bad = F.concat(F.lit("malformed CSV row: "), col(REJECT))
        checked = F.when(col(REJECT).isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True))
        raw = raw.where(checked).drop(REJECT)
    text = raw.select(*[_null_tokens(col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        target = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
        return text.select(*[col(c).cast(target[c]).alias(c) if c in target else col(c) for c in text.columns])
    if not infer:
        return text
    types = _infer_types(text)
    return text.select(*[col(c).cast(types[c]).alias(c) for c in text.columns])


#: The column that holds a malformed row's text while a file is read.
REJECT = "_rejected_row"


def _csv_rows(spark: SparkSession, path, recursive: bool, multi_line: bool, pattern: str | None) -> DataFrame:
    """All cells as text, and the text of rows that do not fit the header."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("recursiveFileLookup", recursive).option("enforceSchema", False)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    names = reader.option("inferSchema", False).csv(path).columns
    if REJECT in names:
        raise ValueError(f"the column name {REJECT!r} is reserved")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECT]])
    return reader.schema(schema).option("columnNameOfCorruptRecord", REJECT).option("mode", "PERMISSIVE").csv(path)


def csv_rejects(
    spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False, multi_line: bool = False,
    pattern: str | None = None,
) -> DataFrame:
    """(row): the text of every row that :func:`read_csv` would not take."""
    rows = _csv_rows(spark, path, recursive, multi_line, pattern)
    # a row is only held against all cells that are read, so they are read along and cut off again
    cells = [col(c) for c in rows.columns if c != REJECT]
    whole = F.left(F.concat_ws("", col(REJECT), *cells), F.length(col(REJECT)))
    # a plain null test would be pushed into the parser, which fills the column only after its filters
    given = F.coalesce(F.length(col(REJECT)), F.lit(-1)) >= 0
    return rows.where(given).select(whole.alias("row"))


# Candidate types, narrowest first, with a test of the text each accepts. A whole number never
# becomes a double that cannot hold all its digits.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CANDIDATES = (
    ("boolean", lambda c: c.rlike(r"^(?i:true|false)$")),
    ("bigint", lambda c: c.rlike(r"^[+-]?\d{1,19}$") & c.try_cast("bigint").isNotNull()),
    ("decimal(38,0)", lambda c: c.rlike(r"^[+-]?\d{1,38}$")),
    ("double", lambda c: c.rlike(_NUMBER) & ~c.rlike(r"^[+-]?0*[1-9]\d{15,}$")),
)


def _infer_types(text: DataFrame) -> dict[str, str]:
    """One wide aggregate; the result is one row, whatever the file size."""
    checks = [
        F.bool_and(accepts(col(name))).alias(f"{i}_{kind}")
        for i, name in enumerate(text.columns)
        for kind, accepts in CANDIDATES
    ]
    row = text.agg(*checks).first() if checks else None
    found = {}
    for i, name in enumerate(text.columns):
        fits = [kind for kind, _ in CANDIDATES if row[f"{i}_{kind}"]]
        found[name] = fits[0] if fits else "string"
    return found


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def object_uri(path: str, default_bucket: str | None = None, scheme: str = "s3a") -> str:
    """A URI Spark can read from ``s3://bucket/key`` or a bare key."""
    if path.startswith("s3://"):
        bucket, _, key = path[5:].partition("/")
        if not key:
            raise ValueError("the path must include an object key, e.g. s3://bucket/key.csv")
        bucket = bucket or default_bucket
    elif "://" in path:
        return path
    else:
        bucket, key = default_bucket, path.lstrip("/")
    if not bucket:
        raise ValueError("no bucket given and no default bucket")
    return f"{scheme}://{bucket}/{key}"


def list_files(
    spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, recursive: bool = True
) -> DataFrame:
    """(path, modificationTime, length, content) of files; content is read only when used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def split_by_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) listings; the test is pushed to the listing, contents stay unread.

    A limit of 0 accepts everything.
    """
    if limit <= 0:
        return files, files.where(F.lit(False)).drop("content")
    accepted = files.where(F.col("length") <= limit)
    return accepted, files.where(F.col("length") > limit).drop("content")


def file_fingerprints(files: DataFrame) -> DataFrame:
    """(path, length, digest): 16 hex digits of each file's SHA-256."""
    return files.select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that depends on the content, not on order or partitions."""
    hashed = df.select(row_hash(df.schema).alias("h"))
    folded = hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("h").alias("x"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))
    return folded.select("rows", F.substring(F.sha2(text, 256), 1, 16).alias("digest"))
