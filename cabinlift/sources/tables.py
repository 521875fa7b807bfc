"""Typed readers and writers. Every schema is declared, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StringType, StructType

from cabinlift import schema as S
from cabinlift.functions.times import month_start
from cabinlift.sources.shared import tidy, written

# Partition column of tables written by month.
MONTH = "travel_month_start"
FLIGHT_ORDER = ["carrier_code", "flight_number"]
LAST_PLACE = (1 << 63) - 1
# Splits of an input up to which their table is broadcast.
FEW_SPLITS = 100_000
# Most rows of a packed CSV file.
PACKED_ROWS = 500_000
# Columns that an input may lack.
OPTIONAL = frozenset((*S.EVENT_LOCAL, *S.COUNTS))


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some value may go on over a line break: a line with an odd number of quotes.

    Reads the text in splits and stops at the first such line.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _raw(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """A table as it is stored. CSV files are split among tasks unless a value goes on over a line break.

    ``multiline`` says so; None has a look. A file with such values, or a packed
    one, is one task.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        if multiline is None:
            multiline = not path.endswith(".gz") and breaks_in_quotes(spark, path)
        # Doubled quotes stand for one, as most writers of CSV have it.
        return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)
    return spark.read.parquet(path)


def read_table(
    spark: SparkSession, path: str, declared: StructType, strict: bool = True, multiline: bool | None = None
) -> DataFrame:
    """Read a CSV (header) or parquet table, keeping the declared columns by name.

    CSV columns are matched by header name, so their order in the file does not
    matter and undeclared columns are skipped. In strict mode a value that does
    not parse raises, and so does a fraction in a column of whole numbers;
    otherwise it becomes null. The availability columns may be absent and are
    then null; any other absent column raises.
    """
    return conform(drop_dotted(_raw(spark, path, multiline)), declared, strict)


# The place of a row in its input: file, offset of the split, row within the split's task.
_PLACE = ["file", "block", "row"]


def _place() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_numbered(spark: SparkSession, path: str, out: str = "row_no", multiline: bool | None = None) -> DataFrame:
    """The table as it is stored, with each row's number in the input, from 0 without gaps.

    Files count in the order of their paths. Splits are numbered by themselves
    and moved on by the rows of the splits before them, so no task sees more
    than its split; the table of splits has a row for each. The result is a
    written table. A column named ``out`` is replaced.
    """
    raw = _raw(spark, path, multiline)
    kept = [F.col(f"`{c}`") for c in raw.columns if c != out]
    placed = written(raw.select(*kept, _place().alias("_place")), "placed")
    place = [F.col(f"_place.{c}").alias(f"_{c}") for c in _PLACE]
    splits = placed.select(*place).groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    splits = written(splits, "splits")
    numbered = placed.withColumns({f"_{c}": F.col(f"_place.{c}") for c in _PLACE}).join(
        F.broadcast(splits) if splits.count() <= FEW_SPLITS else splits, ["_file", "_block"])
    return numbered.select(*kept, (F.col("_before") + F.col("_row") - F.col("_first")).alias(out))


def read_flights(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Flights plus ``ingest_seq``, the row's place in the input.

    The place is (file, offset of the split, row within the split's task), so it
    does not depend on how splits were scheduled.
    """
    raw = _raw(spark, path)
    place = _place()
    typed = [_column(raw, field, strict) for field in S.FLIGHTS.fields]
    if "ingest_seq" not in raw.columns:
        return raw.select(*typed, place.alias("ingest_seq"))
    # A given place is a number; rows without one come last.
    given = F.col("ingest_seq").cast("bigint") if strict else F.col("ingest_seq").try_cast("bigint")
    return raw.select(*typed, F.coalesce(given, F.lit(LAST_PLACE)).alias("ingest_seq"))


def read_offers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read_table(spark, path, S.OFFERS, strict)


def raw_snapshot_input(spark: SparkSession, path: str, min_travel_date: str | None = None) -> DataFrame:
    """Enriched offers as stored; of a table written by month, only the months needed are listed."""
    raw = drop_dotted(_raw(spark, path))
    if MONTH in raw.columns and min_travel_date is not None:
        raw = raw.filter(F.col(MONTH) >= F.trunc(F.lit(min_travel_date).cast("date"), "month"))
    return raw


def read_snapshot_input(
    spark: SparkSession, path: str, strict: bool = True, min_travel_date: str | None = None
) -> DataFrame:
    return conform(raw_snapshot_input(spark, path, min_travel_date), S.ENRICHED_SNAPSHOT, strict)


def read_training_input(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read_table(spark, path, S.TRAINING, strict)


def drop_dotted(df: DataFrame) -> DataFrame:
    """Drop every column whose name contains a dot."""
    return df.drop(*[name for name in df.columns if "." in name])


def _column(df: DataFrame, field, strict: bool):
    if field.name not in df.columns:
        if field.name not in OPTIONAL:
            raise ValueError(f"the input lacks the column {field.name}")
        return F.lit(None).cast(field.dataType).alias(field.name)
    source = F.col(f"`{field.name}`")
    if isinstance(field.dataType, IntegralType) and isinstance(df.schema[field.name].dataType, StringType):
        # Text written from a float column with gaps: 7 appears as 7.0.
        source = source.cast("decimal(38,6)") if strict else source.try_cast("decimal(38,6)")
        whole = F.floor(source) == source
        broken = F.raise_error(F.concat(F.lit(f"{field.name} is not a whole number: "), source.cast("string"))) if strict else F.lit(None)
        source = F.when(source.isNull() | whole, source).otherwise(broken)
    typed = source.cast(field.dataType) if strict else source.try_cast(field.dataType)
    if isinstance(field.dataType, DoubleType):
        typed = F.when(~F.isnan(typed), typed)
    return typed.alias(field.name)


def _made_null(df: DataFrame, field) -> Column:
    """Whether a value is there but becomes null; NaN counts as missing to begin with."""
    source = F.col(f"`{field.name}`")
    there = source.isNotNull()
    if isinstance(field.dataType, DoubleType):
        there = there & ~F.coalesce(F.isnan(source.try_cast("double")), F.lit(False))
    return there & _column(df, field, strict=False).isNull()


def _may_fail(df: DataFrame, declared: StructType) -> list:
    """The declared fields whose stored type is another one, so that values may not fit."""
    return [f for f in declared.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]


def as_declared(df: DataFrame, declared: StructType) -> bool:
    """Whether every declared column is stored with its type, so that nothing is parsed and no value fails."""
    return not _may_fail(df, declared)


def conform_and_count(df: DataFrame, declared: StructType) -> tuple[DataFrame, Observation | None]:
    """``conform`` without raising, and how many values of each column it makes null.

    The counts come with the first job that reads the result, from the same pass.
    Columns that are stored with their declared type cannot fail and are not
    counted; without any other there is nothing to observe and filters still
    reach the scan.
    """
    doubtful = _may_fail(df, declared)
    if not doubtful:
        return conform(df, declared, strict=False), None
    counts = Observation()
    marked = df.withColumns({f"_null_{i}": _made_null(df, field) for i, field in enumerate(doubtful)})
    seen = marked.observe(counts, *[F.count_if(f"_null_{i}").alias(field.name) for i, field in enumerate(doubtful)])
    return conform(seen, declared, strict=False), counts


def coerced_rows(df: DataFrame, declared: StructType) -> DataFrame:
    """The rows in which ``conform`` makes a value null: the declared columns as stored, as text, and ``made_null``.

    ``made_null`` names the columns concerned.
    """
    names = F.array_compact(F.array(*[
        F.when(_made_null(df, field), F.lit(field.name)) for field in _may_fail(df, declared)] or [F.lit(None).cast("string")]))
    stored = [F.col(f"`{f.name}`").cast("string").alias(f.name) for f in declared.fields if f.name in df.columns]
    marked = df.select(*stored, names.alias("made_null"))
    # A filter on the names would move below the projection, and into a join there, with every parsed
    # value written out at each of its uses; a row is given out once or not at all instead.
    concerned = F.filter(F.array("made_null"), lambda found: F.size(found) > 0)
    return marked.select(*[f"`{c}`" for c in marked.columns if c != "made_null"], F.explode(concerned).alias("made_null"))


def conform(df: DataFrame, declared: StructType, strict: bool = True) -> DataFrame:
    """Select the declared columns with their types; absent availability columns become null.

    ``NaN`` becomes null, so that maxima and averages skip it.
    """
    return df.select(*[_column(df, field, strict) for field in declared.fields])


def cast_present(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the listed columns that exist, leave the rest alone."""
    return df.withColumns(
        {name: F.col(name).cast(kind) for name, kind in types.items() if name in df.columns}
    )


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, only_these_partitions: bool = False
) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if only_these_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    with tidy(df.sparkSession):
        writer.parquet(path)


def write_by_month(df: DataFrame, path: str, date: str = "travel_date", only_these_months: bool = False) -> None:
    """Parquet in one folder per month; the hint merges small and splits large ones.

    With ``only_these_months`` the months that ``df`` lacks stay as they are.

    Rows are in flight order inside each file, which compresses well and lets
    readers skip row groups; there is no total order across files.
    """
    dated = df.withColumn(MONTH, month_start(F.col(date)).cast("date"))
    ordered = dated.hint("rebalance", MONTH).sortWithinPartitions(MONTH, date, *FLIGHT_ORDER)
    write_parquet(ordered, path, [MONTH], only_these_months)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV files in a folder; packed ones hold at most ``PACKED_ROWS`` rows, as a reader cannot split them."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if compression:
        writer = writer.option("compression", compression).option("maxRecordsPerFile", PACKED_ROWS)
    with tidy(df.sparkSession):
        writer.csv(path)
