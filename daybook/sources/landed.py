"""Readers for landed files: paged JSON, observation JSON, CSV, yearly files.

Fetching over the network is not part of this package; a landing job writes
the responses to shared storage and these readers pick them up in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR_IN_NAME = r"(\d{4})(?=\.[A-Za-z]+(?:\.gz)?$)"


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All-string schema: raw values are typed in staging, never at the scan."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def page_schema(columns: Sequence[str]) -> T.StructType:
    record = T.StructType([T.StructField("_id", T.LongType()), *text_schema(columns).fields])
    result = T.StructType([T.StructField("total", T.LongType()), T.StructField("records", T.ArrayType(record))])
    return T.StructType([T.StructField("success", T.BooleanType()), T.StructField("result", result)])


def read_pages(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = True) -> DataFrame:
    """One row per landed page, not yet unpacked."""
    return spark.read.schema(page_schema(columns)).option("multiLine", multiline).json(path)


def failed_pages(pages: DataFrame) -> DataFrame:
    """Pages whose payload does not say success, or does not parse."""
    return pages.filter(~F.coalesce(F.col("success"), F.lit(False)))


def page_records(pages: DataFrame) -> DataFrame:
    """All records, without the service's row id. A page without success stops the job that reads it."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    records = F.when(ok, F.col("result.records")).otherwise(F.raise_error(F.lit("a landed page does not say success")))
    return pages.select(F.inline(records)).drop("_id")


def page_progress(pages: DataFrame) -> DataFrame:
    """Failed pages, announced total and records landed, in one row."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return pages.agg(
        F.count_if(~ok).alias("failed"),
        F.max(F.when(ok, F.col("result.total"))).alias("announced"),
        F.coalesce(F.sum(F.when(ok, F.size("result.records"))), F.lit(0)).cast("long").alias("landed"),
    )


def load_pages(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = True) -> DataFrame:
    """The records below ``path``; stops if a page failed, records are missing, or there are none."""
    pages = read_pages(spark, path, columns, multiline)
    seen = page_progress(pages).first()
    if seen.failed:
        raise RuntimeError(f"{seen.failed} landed pages of {path} do not say success")
    if seen.landed < (seen.announced or 0):
        raise RuntimeError(f"{path} announces {seen.announced} records, {seen.landed} landed")
    if not seen.landed:
        raise RuntimeError(f"no rows landed in {path}")
    return page_records(pages)


def observation_schema(series: str) -> T.StructType:
    value = T.StructType([T.StructField("v", T.StringType())])
    obs = T.StructType([T.StructField("d", T.StringType()), T.StructField(series, value)])
    return T.StructType([T.StructField("observations", T.ArrayType(obs))])


def read_observations(spark: SparkSession, path: str, series: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(observation_schema(series)).option("multiLine", multiline).json(path)


def observation_rows(payload: DataFrame, series: str, value: str = "policy_rate", start: str | None = None) -> DataFrame:
    """(date, value) of every observation that has both."""
    rows = payload.select(F.explode("observations").alias("o")).select(
        F.col("o.d").try_cast("date").alias("date"),
        F.col(f"o.`{series}`.v").try_cast("double").alias(value),
    )
    rows = rows.na.drop()
    return rows.filter(F.col("date") >= F.lit(start).cast("date")) if start else rows


CORRUPT = "_corrupt_record"


def csv_layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by the header row they start with; empty files have no layout."""
    out: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        header = tuple(spark.read.option("header", True).option("encoding", "UTF-8").csv(file).columns)
        if header:
            out.setdefault(header, []).append(file)
    return out


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str], tag: str | None = None) -> DataFrame:
    """CSV files with a header row each, matched by column name, every value as text.

    Files that share a header are one scan; a column that a file lacks is NULL,
    others than ``columns`` are left out, a byte-order mark is fine. A row with
    too few or too many fields keeps those it has and is marked with its text in
    ``_corrupt_record`` (see ``corrupt_rows``). Files that vanish stop the job.
    ``tag`` adds the year in the file's or its folder's name (``...2021.csv``,
    ``_source_year=2021/``).
    """
    frames = []
    for header, files in csv_layouts(spark, path).items():
        schema = text_schema([*header, CORRUPT])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8")
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        # Only a row that is parsed as a whole shows that it has a wrong number of fields.
        rows = reader.option("columnPruning", False).csv(files)
        year = F.coalesce(
            F.regexp_extract(F.col("_metadata.file_name"), YEAR_IN_NAME, 1).try_cast("int"),
            F.regexp_extract(F.col("_metadata.file_path"), rf"/{tag}=(\d+)/", 1).try_cast("int"),
        )
        named = [F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns]
        frames.append(rows.select(*named, CORRUPT, *([year.alias(tag)] if tag else [])))
    if not frames:
        raise RuntimeError(f"no CSV files with a header row in {path}")
    return stack(*frames)


def read_yearly_csv(spark: SparkSession, path: str, columns: Sequence[str], tag: str = "_source_year") -> DataFrame:
    """Yearly files as one table, tagged with their year."""
    return read_csv(spark, path, columns, tag)


def corrupt_rows(rows: DataFrame, keys: Sequence[str], named: str) -> DataFrame:
    """Per key: all rows, those that have a value in column ``named``, and those with a wrong number of fields."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.col(f"`{named}`")).alias("n_named"),
        F.count(CORRUPT).alias("n_corrupt"),
    )


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_available(sources: Sequence[DataFrame], path: str, years: Sequence[int] | None = None, key: str = "_source_year") -> DataFrame:
    """Per year, the rows of the first source that has any; a year no source has is skipped.

    Which years a source has is one aggregate over its year column; the chosen
    (year, source) pairs, a row per year, are written below ``path`` and filter every
    source's own scan. Rows are neither copied nor shuffled.
    """
    sources = [df.filter(F.col(key).isin(*years)) if years is not None else df for df in sources]
    have = [df.groupBy(F.col(key).alias("_year")).agg(F.lit(i).alias("_rank")) for i, df in enumerate(sources)]
    stack(*have).groupBy("_year").agg(F.min("_rank").alias("_best")).write.parquet(path)
    best = sources[0].sparkSession.read.schema(f"_year {sources[0].schema[key].dataType.simpleString()}, _best int").parquet(path)

    def chosen(i: int, df: DataFrame) -> DataFrame:
        mine = F.broadcast(best.filter(F.col("_best") == i).select("_year"))
        return df.join(mine, F.col(key).eqNullSafe(F.col("_year")), "left_semi")

    return stack(*[chosen(i, df) for i, df in enumerate(sources)])


def pick_resources(catalog: DataFrame, fmt: str = "CSV") -> DataFrame:
    """Catalogue entries of a format; the queryable ones if there are any, else all."""
    hits = catalog.filter(F.upper(F.coalesce(F.col("format"), F.lit(""))) == fmt)
    active = F.coalesce(F.col("datastore_active"), F.lit(False))
    any_active = hits.agg(F.coalesce(F.bool_or(active), F.lit(False))).scalar()
    return hits.filter(active | ~any_active)


def latest_landed(manifest: DataFrame, key: str | Sequence[str], fetched_at: str = "fetched_at") -> DataFrame:
    """The newest manifest row per key, by a partial + final aggregate (no window)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in manifest.columns if c not in keys and c != fetched_at]
    newest = F.max(F.struct(fetched_at, *rest)).alias("_row")
    return manifest.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def freshness(latest: DataFrame, now: Column, ttl_hours: Column | float, fetched_at: str = "fetched_at") -> DataFrame:
    """Age in hours and whether the landed copy is still young enough to reuse."""
    ttl = ttl_hours if isinstance(ttl_hours, Column) else F.lit(float(ttl_hours))
    age = F.timestamp_diff("MICROSECOND", F.col(fetched_at), now) / F.lit(3.6e9)
    return latest.withColumn("age_hours", age).withColumn("is_fresh", F.col("age_hours") < ttl)
