"""CSV records of files of any size, read in parallel although quoted fields may hold line breaks.

The splittable text source gives physical lines.  A line is a function of the
state before it (outside or inside a quoted field) to the state after it: it
keeps the state, swaps it, or sets it whatever it was.  Such functions compose,
so the state before every line is a prefix scan:

1. *Screen.*  One aggregation over the lines names the files in which some
   line, begun outside, ends inside a field (or a carriage return stands within
   a line).  In all others every line is a record, and Spark's own splittable
   CSV reader reads them.
2. *Ranges.*  The lines of the named files get, within the file range that one
   task reads, the swaps so far and the last line that set the state.  This is
   frozen, so all later steps see the same ranges.
3. *Offsets.*  The last line of a range sums it up; a scan over the ranges of a
   file, one row each, gives the state before each range.
4. *Records.*  A line that begins and ends outside is a record.  The lines of a
   longer one carry the number of its first line, from their range or the last
   range before it with such a line, and are joined by it.

In a file whose first line ends with a carriage return and a line feed, such
pairs count as line feeds, also within fields.  Work per task is bounded by a file range and by a record.  A quote that is
never closed makes the rest of its file one record, as for any CSV reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.joins import broadcast_or_merge
from ..operators.ordering import checkpointed

#: fixed values: the dialect of landing files
DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: files named one by one in a filter; with more, all files take the scan
MAX_NAMED_FILES = 1000

# Fields of a line, without backtracking: a quoted one up to its closing quote and what stands after it, or a plain one.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"(?!")[^,]*+|(?!")[^,]*+)'
#: from outside: whole fields, then one that is not closed
_OPENS = rf'^(?:{_FIELD},)*+"{_INSIDE}$'
#: from inside: never closed; or closed, then whole fields, then one that is not closed
_STAYS = rf'^{_INSIDE}$'
_REOPENS = rf'^{_INSIDE}"(?!")[^,]*+,(?:{_FIELD},)*+"{_INSIDE}$'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the range read with the line), line_id (grows within a range), value."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), "value")


def _states(value: Column) -> tuple[Column, Column]:
    """State after the line (1 inside), begun outside and begun inside."""
    quoted = value.contains('"')
    from_outside = F.when(quoted & value.rlike(_OPENS), 1).otherwise(0)
    from_inside = F.when(quoted & ~value.rlike(_STAYS) & ~value.rlike(_REOPENS), 0).otherwise(1)
    return from_outside, from_inside


def broken_files(all_lines: DataFrame) -> list[str]:
    """Files in which a record may be longer than a line; ``MAX_NAMED_FILES`` + 1 at most."""
    opens, _ = _states(F.col("value"))
    inner_return = F.col("value").rlike("\r(?!$)")
    odd = all_lines.groupBy("file").agg(F.max(F.when((opens == 1) | inner_return, 1).otherwise(0)).alias("odd")).where("odd = 1")
    return [r.file for r in odd.select("file").limit(MAX_NAMED_FILES + 1).collect()]


def _scan(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds, for rows with ``swaps`` (0 or 1) and ``sets`` (state or null), the scan before and after each row:
    odd_* (swaps so far, modulo 2) and set_* (state that the last setting row implies at no swaps, or null)."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("odd_after", F.pmod(F.sum("swaps").over(upto), F.lit(2)).cast("int"))
    rows = rows.withColumn("implied", F.when(F.col("sets").isNotNull(), F.col("sets").bitwiseXOR(F.col("odd_after"))))
    return (rows.withColumn("odd_before", F.pmod(F.col("odd_after") - F.col("swaps"), F.lit(2)))
            .withColumn("set_after", F.last("implied", ignorenulls=True).over(upto))
            .withColumn("set_before", F.last("implied", ignorenulls=True).over(before)).drop("implied"))


def _state(begin: Column | str, when: str) -> Column:
    begin = F.col(begin) if isinstance(begin, str) else begin
    return F.coalesce(F.col(f"set_{when}"), begin).bitwiseXOR(F.col(f"odd_{when}"))


def joined_records(all_lines: DataFrame) -> DataFrame:
    """file, line_id (of its first line), block and record: the lines of each record joined by line feeds."""
    out, inside = _states(F.col("value"))
    rows = (all_lines.withColumn("_out", out).withColumn("_in", inside)
            .withColumn("swaps", F.when((F.col("_out") == 1) & (F.col("_in") == 0), 1).otherwise(0))
            .withColumn("sets", F.when(F.col("_out") == F.col("_in"), F.col("_out"))).drop("_out", "_in"))
    ranged = checkpointed(_scan(rows, ["file", "block"], "line_id"))
    # one row a range: its function, from its last line
    blocks = ranged.groupBy("file", "block").agg(F.max_by(F.struct("odd_after", "set_after"), "line_id").alias("f"))
    sets = F.col("f.set_after").bitwiseXOR(F.col("f.odd_after"))
    blocks = blocks.select("file", "block", F.when(F.col("f.set_after").isNull(), F.col("f.odd_after")).otherwise(0).alias("swaps"),
                           sets.alias("sets"))
    begins = checkpointed(_scan(blocks, ["file"], "block").select("file", "block", _state(F.lit(0), "before").alias("begin")))
    known = ranged.join(broadcast_or_merge(begins), ["file", "block"])
    known = known.select("file", "block", "line_id", "value", (_state("begin", "before") == 0).alias("starts"),
                         (_state("begin", "after") == 0).alias("ends"))
    single = known.where("starts AND ends").select("file", "line_id", "block", F.col("value").alias("record"))
    within = Window.partitionBy("file", "block").orderBy("line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = checkpointed(known.where("NOT (starts AND ends)").withColumn(
        "first", F.last(F.when(F.col("starts"), F.struct("block", "line_id")), ignorenulls=True).over(within)))
    # an open record goes on in the next ranges: the last first line before them is its own
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (pieces.groupBy("file", "block").agg(F.max("first").alias("newest"))
               .withColumn("carried", F.last("newest", ignorenulls=True).over(earlier)).select("file", "block", "carried"))
    whole = (pieces.join(broadcast_or_merge(checkpointed(carried)), ["file", "block"])
             .withColumn("first", F.coalesce("first", "carried"))
             .groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("block", "line_id", "value"))).alias("lines"))
             .select("file", F.col("first.line_id").alias("line_id"), F.col("first.block").alias("block"),
                     F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record")))
    return single.unionByName(whole)


def _parsed(records: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the records below each file's header."""
    first = records.groupBy("file").agg(F.min(F.struct("block", "line_id", "record")).alias("h")).select(
        "file", F.col("h.line_id").alias("header"), F.col("h.record").rlike("^[^\n]*\r(\n|$)").alias("crlf"))
    body = (records.join(broadcast_or_merge(checkpointed(first)), "file").where("line_id <> header")
            .select(F.when(F.col("crlf"), F.regexp_replace(F.regexp_replace("record", "\r\n", "\n"), "\r$", ""))
                    .otherwise(F.col("record")).alias("record")).where("record <> ''"))
    schema = StructType([StructField(c, StringType()) for c in columns])
    options = {**DIALECT, "mode": "FAILFAST", "multiLine": "true", "maxCharsPerColumn": "-1"}
    return body.select(F.from_csv("record", schema.simpleString() if _plain(columns) else schema.toDDL(), options).alias("r")).select("r.*")


def _plain(columns: list[str]) -> bool:
    return all(c.replace("_", "a").isalnum() and c[0].isalpha() for c in columns if c) and all(columns)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the CSV files at ``path`` as strings, header names as they stand."""
    whole = spark.read.options(**DIALECT, header="true", inferSchema="false")
    columns = whole.option("multiLine", "true").csv(path).columns  # reads the header
    schema = StructType([StructField(c, StringType()) for c in columns])
    everything = lines(spark, path)
    broken = broken_files(everything)
    records = spark.read.options(**DIALECT, header="true", mode="FAILFAST").schema(schema).csv(path)
    if not broken:
        return records
    if len(broken) > MAX_NAMED_FILES:
        return _parsed(joined_records(everything), columns)
    named = F.col("_metadata.file_path").isin(broken)
    scanned = joined_records(everything.where(F.col("file").isin(broken)))
    return records.where(~named).unionByName(_parsed(scanned, columns))
