"""Sources and sinks: NumPy signal files, header texts, CSV and JSON, stage tables, side outputs for what can't be read.

Paths are Spark paths: listing and reading go through Spark's readers, so any file system it knows will do.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clinical import header_entry, record_of_path
from ..schemas import CLINICAL, HEADER_FIELDS, TEXT_FIELDS


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that there is."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def list_records(spark: SparkSession, folder: str, suffix: str = "_fhr.npy") -> DataFrame:
    """Records that have a file of this kind, by name. Only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.select(record_of_path(F.col("path"), suffix).alias("record"), "path").orderBy("record")


def read_npy(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Signals of one kind: record, x (NULL for NaN), error. A file that isn't a one-dimensional array has an error and no x."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                    if x.ndim != 1:
                        raise ValueError(f"{x.ndim} dimensions")
                    xs.append(pa.array(x, from_pandas=True))
                    errors.append(None)
                except (ValueError, OSError, EOFError) as e:
                    xs.append(None)
                    errors.append(str(e) or type(e).__name__)
            arrays = pa.array([x.to_pylist() if x is not None else None for x in xs], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays, pa.array(errors, pa.string())], ["record", "x", "error"])

    return files.select(record_of_path(F.col("path"), suffix).alias("record"), "content").mapInArrow(run, "record string, x array<double>, error string")


def npy_lengths(spark: SparkSession, folder: str, suffix: str = "_fhr.npy", item_bytes: int = 4, header_bytes: int = 128) -> DataFrame:
    """Samples per file from its size alone: contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(record_of_path(F.col("path"), suffix).alias("record"), ((F.col("length") - header_bytes) / item_bytes).cast("bigint").alias("n_samples"))


def pair_channels(fhr: DataFrame, uc: DataFrame, missing: str = "skip", fs: int = 4) -> DataFrame:
    """record, fhr, uc, fs, trimmed to the common length. missing: `skip` records without contractions, `null` keeps them with NULL, `error` fails."""
    if missing not in ("skip", "null", "error"):
        raise ValueError(missing)
    u = uc.select("record", F.col("x").alias("uc"))
    both = fhr.select("record", F.col("x").alias("fhr")).join(u, "record", "inner" if missing == "skip" else "left")
    if missing == "error":
        both = both.where(F.assert_true(F.col("uc").isNotNull(), "a record has no contraction signal").isNull())
    n = F.least(F.size("fhr"), F.when(F.col("uc").isNotNull(), F.size("uc")))
    return both.select("record", F.slice("fhr", F.lit(1), n).alias("fhr"), F.slice("uc", F.lit(1), n).alias("uc"), F.lit(fs).alias("fs"))


def first_pairs(signals: DataFrame, n: int) -> DataFrame:
    """The first n records by name of a table of paired channels."""
    return signals.orderBy("record").limit(n)


def not_yet(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records that the manifest doesn't have: what is left to load."""
    return records.join(manifest.select("record"), "record", "left_anti")


def read_wfdb(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of records in WFDB's 16-bit format (a .hea and a .dat file each): record, fhr, uc, fs, error.

    A channel is the first whose description has `fhr` or `uc` in it, else NULL. Samples are physical values by
    their gain and baseline; the format's mark for no sample is NULL. What isn't in that format has an error.
    """
    read = lambda kind: spark.read.format("binaryFile").option("pathGlobFilter", f"*{kind}").load(folder).select(record_of_path(F.col("path"), kind).alias("record"), "content")
    both = read(".hea").join(read(".dat").withColumnRenamed("content", "data"), "record", "left")

    def decode(head: bytes, data: bytes | None) -> tuple[list, list, int]:
        lines = [x for x in head.decode("latin-1").splitlines() if x.strip() and not x.startswith("#")]
        _, channels, fs, *_ = lines[0].split()
        rows = [x.split(None, 8) for x in lines[1 : 1 + int(channels)]]
        if data is None or any(r[1].split("+")[0].split("x")[0] != "16" for r in rows):
            raise ValueError("no samples in 16-bit format")
        raw = np.frombuffer(data[: len(data) // (2 * len(rows)) * 2 * len(rows)], "<i2").reshape(-1, len(rows)).astype(np.float64)
        out = []
        for part in ("fhr", "uc"):
            k = next((i for i, r in enumerate(rows) if part in r[-1].lower()), None)
            if k is None:
                out.append(None)
                continue
            gain, _, zero = rows[k][2].split("/")[0].partition("(")
            base = float(zero.rstrip(")")) if zero else float(rows[k][4])
            x = np.where(raw[:, k] == -(1 << 15), np.nan, (raw[:, k] - base) / (float(gain) or 200.0))
            out.append([None if np.isnan(v) else v for v in x.tolist()])
        return out[0], out[1], int(float(fs.split("/")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for head, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    rows.append((*decode(head, data), None))
                except (ValueError, IndexError) as e:
                    rows.append((None, None, None, str(e) or type(e).__name__))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["record", "fhr", "uc", "fs", "error"])

    return both.select("record", "content", "data").mapInArrow(run, "record string, fhr array<double>, uc array<double>, fs int, error string")


def channel_of(names: Column, part: str) -> Column:
    """The first position whose channel name has the part in it, NULL if none."""
    return F.try_element_at(F.filter(F.transform(names, lambda n, i: F.when(F.contains(F.lower(n), F.lit(part)), i)), lambda i: i.isNotNull()), F.lit(1))


def download_status(fhr: Column, uc: Column, known: Column, error: Column) -> Column:
    """ok, sin_uc, ya_existe or error."""
    empty = uc.isNull() | (F.size(F.filter(uc, lambda v: v.isNotNull())) == 0)
    return F.when(known, "ya_existe").when(error.isNotNull() | fhr.isNull(), "error").when(empty, "sin_uc").otherwise("ok")


def read_headers(spark: SparkSession, folder: str, suffix: str = ".hea") -> DataFrame:
    """Clinical columns of each header file, by the fixed schema; unknown keys are ignored, what doesn't parse is NULL."""
    lines = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}").select(record_of_path(F.col("_metadata.file_path"), suffix).alias("record"), F.col("value"))
    return parse_headers(lines.select("record", F.explode(F.split("value", r"\r?\n")).alias("line")))


def parse_headers(lines: DataFrame) -> DataFrame:
    """Rows (record, line) to one row per record; a leading # of a line is dropped, and of a repeated key the last in order of value counts."""
    e = lines.select("record", header_entry(F.regexp_replace("line", r"^#\s?", "")).alias("e")).where("e IS NOT NULL").select("record", "e.*")
    e = e.where(F.col("key").isin(list(HEADER_FIELDS)))
    cols = [F.max(F.when(F.col("key") == k, F.col("value"))) for k in HEADER_FIELDS]
    typed = [(c if name in TEXT_FIELDS else c.try_cast("double")).alias(name) for c, name in zip(cols, HEADER_FIELDS.values(), strict=True)]
    return e.groupBy("record").agg(*typed).select(CLINICAL.fieldNames())


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, nullValue="")


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """A CSV file's column names, from its first line."""
    return spark.read.csv(path, header=True).columns


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; with `mark` each file begins with the UTF-8 byte order mark, as some spreadsheets want."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def to_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as an indented JSON document."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias(name))


def write_signals(df: DataFrame, path: str) -> None:
    """The signal store: Parquet by origin, so reading one kind prunes the other."""
    df.write.mode("overwrite").partitionBy("is_synthetic").parquet(path)


def stage_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a stage's table, built first if it isn't there whole."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def require_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path}: run {stage} first")
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Split:
    """What a split write left: good rows, bad rows with their error, and what was counted on the way."""

    good: DataFrame
    bad: DataFrame
    counts: dict


def split_write(df: DataFrame, error: Column, path: str, counts: dict[str, Column] | None = None) -> Split:
    """Write rows once, good and bad apart, and count what was written: `rows`, `bad`, and the aggregates in `counts`, of df's columns.

    A row is bad if `error` isn't NULL. The input is evaluated once; counts come from the columns that they need of
    the files. (Observations would count on the way, but leave a session in which Spark's learners can't be
    serialised.) A second run replaces what the first one wrote.
    """
    marked = df.withColumn("__error", error.cast("string")).withColumn("__bad", F.col("__error").isNotNull())
    marked.write.mode("overwrite").partitionBy("__bad").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("__error", T.StringType()), T.StructField("__bad", T.BooleanType())])
    back = df.sparkSession.read.schema(schema).parquet(path)
    measures = {"rows": F.count(F.lit(1)), "bad": F.count("__error")} | (counts or {})
    found = back.agg(*[c.alias(n) for n, c in measures.items()]).first()
    said = F.col("__error").alias("error") if "error" not in df.columns else F.col("__error")
    return Split(back.where(~F.col("__bad")).select(*df.columns), back.where("__bad").select(*df.columns, said), found.asDict())


def quarantine(df: DataFrame, error: str, path: str) -> DataFrame:
    """Good rows; bad ones (error set) are written as JSON. The input is evaluated once, into Parquet beside it in a folder that readers pass over; a rerun replaces both."""
    parent, _, name = path.rstrip("/").rpartition("/")
    parts = split_write(df, F.col(error), f"{parent or '.'}/_{name}.split")
    parts.bad.select(*df.columns).write.mode("overwrite").json(path)
    return parts.good.drop(error)


def write_text(path: str, text: str) -> None:
    """A small text as a file of any file system that Spark knows."""
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    f = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        f.write(bytearray(text.encode()))
    finally:
        f.close()


def read_text(path: str) -> str:
    return SparkSession.active().read.text(path, wholetext=True).first()[0]


def demo_series(spark: SparkSession, n: int = 20, seed: int = 42) -> DataFrame:
    """n noisy sine series (record, x) of 5000 to 19999 samples within 80 to 200, 5 % missing. Noise is hashed: a sum of twelve even numbers less six."""
    from ..functions.clinical import hash_unit

    base = spark.range(n).select(F.format_string("demo_%02d", "id").alias("record"), "id")
    size = (F.floor(hash_unit(F.lit(seed), F.lit("n"), F.col("id")) * 15000) + 5000).cast("int")

    def sample(i: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(seed), F.col("id"), i))
        noise = sum((F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("double") / 256.0 for k in range(12)), F.lit(0.0)) - 6.0 + 12 / 512
        value = F.least(F.greatest(140 + 10 * noise + 5 * F.sin(2 * 3.141592653589793 * i / 1200), F.lit(80.0)), F.lit(200.0))
        return F.when(F.conv(F.substring(h, 25, 8), 16, 10).cast("long") / F.lit(4294967296.0) >= 0.05, value)

    return base.select("record", F.transform(F.sequence(F.lit(0), size - 1), sample).alias("x"))
