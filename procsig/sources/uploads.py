"""Uploaded CSV files, read line by line so that every file keeps its own header and order.

A schema for the whole folder cannot say which file lacks a column, and a plain scan does not keep the
order of a file's lines. Here each line carries its file and an ``ingest_seq`` (byte offset of its block,
place in the block): lines of a file are ordered by it, and it survives writing and shuffling. The first line of a file
is its header; the other lines become maps from that file's column names to text values.

Lines are records: values hold no line breaks. Empty lines are skipped, missing values at a line's end
are NULL, values beyond the header are dropped. Files with another suffix than ``.csv`` are ignored.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsig.plans.guard import bounded_broadcast
from procsig.session import cut_lineage

#: Files, or sources, up to which their table (a row each) is broadcast.
MAX_FILES = 100_000


def upload_folder() -> Column:
    """Source id of files that belong together: the folder they lie in. Evaluated per line: no pattern, which would
    try every place of the path."""
    return F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)


def read_lines(spark: SparkSession, folder: str, source: Column | None = None) -> DataFrame:
    """``source, file, ingest_seq, line`` of every CSV file below ``folder``; the source is the file's name by default."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(folder))
    return lines.select(
        (source if source is not None else F.col("_metadata.file_name")).alias("source"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("ingest_seq"),
        F.col("value").alias("line")).where(F.trim("line") != "")


def headers(lines: DataFrame) -> DataFrame:
    """``file, header_seq, names``: one row per file, from its first line.

    The least place of every block is a hash aggregate of numbers, so no line is sorted; the table of files is
    materialised and picks the first lines.
    """
    blocks = lines.groupBy("file", F.col("ingest_seq.block").alias("block")).agg(F.min("ingest_seq.place").alias("place"))
    first = cut_lineage(blocks.groupBy("file").agg(F.min(F.struct("block", "place")).alias("header_seq")))
    found = lines.join(bounded_broadcast(first, MAX_FILES), "file").where(F.col("ingest_seq") == F.col("header_seq"))
    names = F.transform(F.split("line", ","), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$|^\ufeff', "")))
    return cut_lineage(found.select("file", "header_seq", names.alias("names")))


def records(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``source, file, ingest_seq, names, values map<string,string>`` of all lines but the headers."""
    width = max(1, heads.agg(F.max(F.size("names"))).first()[0] or 1)
    schema = ", ".join(f"c{i} string" for i in range(width))
    joined = lines.join(bounded_broadcast(heads, MAX_FILES), "file").where(F.col("ingest_seq") > F.col("header_seq"))
    cells = F.slice(F.array(*[F.col(f"cells.c{i}") for i in range(width)]), F.lit(1), F.size("names"))
    parsed = joined.select("source", "file", "ingest_seq", "names", F.from_csv("line", F.lit(schema), {"escape": '"'}).alias("cells"))
    pairs = F.transform(cells, lambda x: F.nullif(F.trim(x), F.lit("")))
    return parsed.select("source", "file", "ingest_seq", "names", F.map_from_arrays("names", pairs).alias("values"))


def validate_uploads(rows: DataFrame, run: str, sample: str, features: Sequence[str], min_rows: int = 3) -> DataFrame:
    """V1 + V2 per source, each judged by the headers and values of its own files.

    ``rows``: ``records``. Fewer than ``min_rows`` rows end the checks of a source. One grouped aggregate over the
    rows and one window over their order.
    """
    keys, wanted = [run, sample], list(features)
    value = lambda c: F.try_element_at("values", F.lit(c))
    number = lambda c: value(c).try_cast("double")
    text = [F.count_if(value(f).isNotNull() & number(f).isNull()).alias(f"t{i}") for i, f in enumerate(wanted)]
    absent = [F.max(~F.array_contains("names", c)).alias(f"a{i}") for i, c in enumerate(keys + wanted)]
    empty = [F.count_if(F.array_contains("names", k) & value(k).isNull()).alias(f"e{i}") for i, k in enumerate(keys)]
    per = rows.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.max(F.size("names")).alias("n_cols"), F.count_distinct(value(run)).alias("n_runs"),
        F.min(number(sample)).alias("sample_min"), F.max(number(sample)).alias("sample_max"), *text, *absent, *empty)
    order = in_file_order(rows.select("source", "file", "ingest_seq", number(sample).alias("sample")))
    per = per.join(order, "source", "left")
    named = lambda names, cond: F.array_compact(F.array(*[F.when(cond(i), F.lit(c)) for i, c in enumerate(names)]))
    told = lambda prefix, found, keep=None: F.when(F.size(found) > 0, F.concat(
        F.lit(prefix + ": "), F.array_join(found if keep is None else F.slice(found, 1, keep), ", ")))
    errors = F.array_compact(F.array(
        told("Missing key columns", named(keys, lambda i: F.col(f"a{i}"))),
        told("Missing feature columns", named(wanted, lambda i: F.col(f"a{i + len(keys)}"))),
        told("Non-numeric feature columns", named(wanted, lambda i: F.col(f"t{i}") > 0), 3),
        told("NULL values in key columns", named(keys, lambda i: F.col(f"e{i}") > 0))))
    warnings = F.array_compact(F.array(
        F.when(F.col("n_decreases") > 0, F.lit("Samples are not in ascending order")),
        F.when(F.col("n_runs") > 1, F.concat(F.lit("Multiple runs found: "), F.col("n_runs").cast("string")))))
    few = F.col("n_rows") < min_rows
    none = F.array().cast("array<string>")
    too_few = F.array(F.concat(F.lit(f"Need at least {min_rows} rows, got "), F.col("n_rows").cast("string")))
    return per.select("source", "n_rows", "n_cols", "n_runs", "sample_min", "sample_max", F.when(few, too_few).otherwise(errors).alias("errors"),
                      F.when(few, none).otherwise(warnings).alias("warnings")).withColumn("is_valid", F.size("errors") == 0)


def in_file_order(rows: DataFrame) -> DataFrame:
    """W8 in the order of the files: ``source, n_decreases`` of ``sample`` from one line to the next of the same file.

    Lines of a block are compared where they lie; only the first and last line of a block meet those of its
    neighbours, so no file is gathered in one task.
    """
    from pyspark.sql.window import Window
    block = Window.partitionBy("source", "file", "ingest_seq.block").orderBy("ingest_seq.place")
    inner = rows.select("*", F.lag("sample").over(block).alias("before"))
    per = inner.groupBy("source", "file", F.col("ingest_seq.block").alias("block")).agg(
        F.count_if(F.col("before") > F.col("sample")).alias("n"), F.min_by("sample", "ingest_seq").alias("first"), F.max_by("sample", "ingest_seq").alias("last"))
    across = Window.partitionBy("file").orderBy("block")  # one row per block
    joined = per.select("source", "n", (F.lag("last").over(across) > F.col("first")).alias("falls"))
    return joined.groupBy("source").agg((F.sum("n") + F.count_if("falls")).alias("n_decreases"))


def default_request(rows: DataFrame, run: str, sample: str) -> DataFrame:
    """T5 / P10: per source the run of its first line and its largest sample, which a request without them means.

    The first line is that of the least (file, ingest sequence), whatever the order the rows come in: a hash aggregate of
    numbers per block (no row is sorted), the least of the blocks, and a look-up of these lines, one per source.
    """
    value = lambda c: F.try_element_at("values", F.lit(c))
    blocks = rows.groupBy("source", "file", F.col("ingest_seq.block").alias("block")).agg(
        F.min("ingest_seq.place").alias("place"), F.max(value(sample).try_cast("double")).alias("target"))
    per = cut_lineage(blocks.groupBy(F.col("source").alias("_source")).agg(
        F.min(F.struct("file", "block", "place")).alias("_at"), F.max("target").cast("long").alias("target")))
    same = (F.col("source").eqNullSafe(F.col("_source")) & (F.col("file") == F.col("_at.file"))
            & (F.col("ingest_seq.block") == F.col("_at.block")) & (F.col("ingest_seq.place") == F.col("_at.place")))
    return rows.join(bounded_broadcast(per, MAX_FILES), same).select("source", value(run).alias("run"), "target").dropDuplicates(["source"])


def requested_window(rows: DataFrame, requests: DataFrame, run: str, sample: str, length: int = 3) -> DataFrame:
    """The rows ``target - length + 1 .. target`` of each source's requested run (P10), with ``ok``: whether all are there."""
    value = lambda c: F.try_element_at("values", F.lit(c))
    requests = cut_lineage(requests)  # one row per source, used twice
    near = rows.select("source", value(run).alias("run"), value(sample).try_cast("double").alias("sample"))
    hit = near.join(bounded_broadcast(requests, MAX_FILES), ["source", "run"]).where(F.col("sample").between(F.col("target") - (length - 1), F.col("target")))
    found = hit.groupBy("source").agg(F.count_distinct("sample").alias("n_samples"), F.count("*").alias("n_rows"))
    return requests.join(found, "source", "left").select(
        "source", "run", "target", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.coalesce("n_samples", F.lit(0)) == length).alias("ok"))


def validate_folder(spark: SparkSession, folder: str, run: str, sample: str, features: Sequence[str], min_rows: int = 3,
                    source: Column | None = None) -> DataFrame:
    """``validate_uploads`` of all files below ``folder``; a source with nothing but headers has 0 rows."""
    lines = read_lines(spark, folder, source)
    report = validate_uploads(records(lines, headers(lines)), run, sample, features, min_rows)
    told = lines.select("source").distinct().join(report, "source", "left")
    none = F.array(F.lit(f"Need at least {min_rows} rows, got 0"))
    return told.select("source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_cols", F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
                       "sample_min", "sample_max", F.coalesce("errors", none).alias("errors"),
                       F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.coalesce("is_valid", F.lit(False)).alias("is_valid"))
