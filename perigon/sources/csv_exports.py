"""Per-family CSV exports as the canonical observation table."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon.config import DEFAULT, OBS_COLUMNS, OPTIONAL_COLUMNS, Config
from perigon.functions import names
from perigon.operators import documents
from perigon.sources import csv_splits

#: Sequence numbers of the n-th file start here times n.
FILE_SPAN = 1 << 50


def found_columns(path: str, names: list[str]) -> dict[str, int]:
    """Place of each used column in a header; of columns with one name the last counts."""
    found = {name: k for k, name in enumerate(names) if name in OBS_COLUMNS}
    missing = [c for c in OBS_COLUMNS if c not in found and c not in OPTIONAL_COLUMNS]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return found


def read_family(spark: SparkSession, path: str, rank: int, range_bytes: int = csv_splits.RANGE) -> DataFrame:
    """One export: its own header, the used columns by name, blanks as '', rows numbered in file order.

    Short rows are filled with blanks, surplus cells dropped. A private coordinate column that the file does not have is
    null, not blank. Many tasks read a file, a range of `range_bytes` each, where Python workers reach its
    file system; else one task does.
    """
    qualified = _qualified(spark, path)
    if not csv_splits.readable(qualified):
        return read_family_whole(spark, path, rank)
    found = found_columns(path, csv_splits.header(qualified)[0])
    rows = csv_splits.read(spark, qualified, found, range_bytes)
    return _canonical(rows, {c: c for c in found}, rank, F.col("number"))


def read_family_whole(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """The same by Spark's reader, a task a file."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False, mode="PERMISSIVE")
    # repeated header names come as name0, name1, ... by position
    plain = [n[: -len(str(k))] if n not in OBS_COLUMNS and n.endswith(str(k)) and n[: -len(str(k))] in OBS_COLUMNS else n for k, n in enumerate(raw.columns)]
    found = found_columns(path, plain)
    return _canonical(raw, {c: raw.columns[k] for c, k in found.items()}, rank, F.monotonically_increasing_id())


def _canonical(rows: DataFrame, found: dict[str, str], rank: int, number: Column) -> DataFrame:
    cells = [F.coalesce(F.col(f"`{found[c]}`"), F.lit("")).alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in OBS_COLUMNS]
    return rows.select(*cells, F.lit(rank).alias("family_rank"), (F.lit(rank).cast("bigint") * FILE_SPAN + number).alias("seq"))


def place() -> Column:
    """Place of a row in its file, from 1: its sequence number has it, so no task sorts a family."""
    return F.col("seq") - F.col("family_rank").cast("bigint") * FILE_SPAN + 1


def write_family(obs: DataFrame, folder: str, name: str, columns: list[str]) -> None:
    """One export as a single file, as the reader expects it, rows in the order of seq; written by many tasks."""
    head = ",".join('"' + c.replace('"', '""') + '"' if re.search('[",\r\n]', c) else c for c in columns)
    rows = obs.select(F.lit(name).alias("file"), "seq", names.csv_line([F.col(f"`{c}`") for c in columns]).alias("element"))
    documents.write_documents(rows, folder, ["seq"], head, names=[name])


def _qualified(spark: SparkSession, path: str) -> str:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the folder that driver and executors share; a temporary folder only where Spark runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="perigon-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_exports(spark: SparkSession, folder: str, config: Config = DEFAULT, range_bytes: int = csv_splits.RANGE) -> DataFrame:
    """All families' exports below a folder, in the configured order; files that do not exist are skipped."""
    there = [(k, p) for k, f in enumerate(config.families) if exists(spark, p := f"{folder}/{f}.csv")]
    if not there:
        raise FileNotFoundError(f"no export of the configured families in {folder}")
    return with_points(reduce(DataFrame.unionByName, [read_family(spark, p, k, range_bytes) for k, p in there]))


def with_points(obs: DataFrame) -> DataFrame:
    """lat and lon as numbers beside the text; null where the text is no number."""
    return obs.withColumns({"lat": F.expr("try_cast(latitude AS double)"), "lon": F.expr("try_cast(longitude AS double)")})
