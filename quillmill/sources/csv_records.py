"""CSV files by record, each by its own header, read in splits.

A line break may lie in quotes, so whether a line starts a record depends on all lines before it. But what a line does to
that state is known from the line alone: it leaves it, turns it over, or ends outside or inside of quotes whatever the
state was. So lines are read in splits, as text; a running window within each split gives the state up to the split's own
start, a window over one row a split gives the states there, and both together number the records of a file. Records are
then put together by (file, number), parsed as an array of cells, and meet the header of their file, which is its record 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'  # an opening quote and what follows up to its closing quote
_CELL = rf'(?s)(?:^|,)(?:{_QUOTED}"?+[^,]*+|[^,]*+)'


def _ends_inside(line: Column) -> Column:
    """Whether a line that starts outside of quotes ends inside."""
    return F.regexp_replace(line, rf'(?s)(^|,){_QUOTED}"(?=,|$)', "$1").rlike(rf"(?s)(?:^|,){_QUOTED}$")


def numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, record, at, line: lines of CSV files with the number, from 1, of the record that they belong to; blank lines
    between records are left out. `at` orders the lines of a record."""
    lines = spark.read.text(paths, lineSep="\n").select(
        F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block")
    )
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    within = F.regexp_extract("line", r'(?s)\A[^"]*+(?:""[^"]*+)*+("?)', 1)  # the quote that ends a cell begun on an earlier line
    rest = F.concat(F.lit("x"), F.regexp_replace("line", r'(?s)\A[^"]*+(?:""[^"]*+)*+"', ""))
    # from outside and from inside of quotes: whether the line ends inside
    lines = lines.withColumns({"out": _ends_inside(F.col("line")), "in": (within == "") | _ends_inside(rest)})
    settles, turns = F.col("out") == F.col("in"), F.col("out") & ~F.col("in")
    order = Window.partitionBy("source_file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(turns.cast("int")).over(order)
    lines = lines.withColumn("turned", turned % 2)
    # the last settled state, with the turns since
    settled = F.last(F.when(settles, F.col("out").cast("int").bitwiseXOR(F.col("turned").cast("int"))), True).over(order)
    lines = lines.withColumn("settled", settled)
    lines = lines.withColumn("after", F.when(F.col("settled").isNotNull(), F.col("settled").bitwiseXOR(F.col("turned").cast("int"))))
    by_at = Window.partitionBy("source_file", "block").orderBy("at")
    lines = lines.withColumns({"before": F.lag("after").over(by_at), "turned_before": F.coalesce(F.lag("turned").over(by_at), F.lit(0)).cast("int")})
    blank = F.col("line").rlike(r"\A[ \t]*\z")
    # a split's records, if it starts outside and if inside of quotes
    starts = {s: (F.coalesce(F.col("before"), F.col("turned_before").bitwiseXOR(F.lit(s))) == 0) & ~blank for s in (0, 1)}
    splits = lines.groupBy("source_file", "block").agg(
        *(F.count_if(c).alias(f"n{s}") for s, c in starts.items()), F.max_by("after", "at").alias("after"), F.max_by("turned", "at").cast("int").alias("turned")
    )
    of_file = Window.partitionBy("source_file").orderBy("block")
    to_here = of_file.rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("flips", F.sum(F.when(F.col("after").isNull(), F.col("turned")).otherwise(0)).over(to_here) % 2)
    known = F.last(F.when(F.col("after").isNotNull(), F.col("after").bitwiseXOR(F.col("flips").cast("int"))), True).over(to_here)
    state = F.coalesce(known, F.lit(0)).bitwiseXOR(F.col("flips").cast("int"))
    splits = splits.withColumn("end", state).withColumn("entry", F.coalesce(F.lag("end").over(of_file), F.lit(0)))
    n = F.when(F.col("entry") == 0, F.col("n0")).otherwise(F.col("n1"))
    earlier = F.coalesce(F.sum(n).over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("source_file", "block", "entry", earlier.alias("earlier"))
    lines = lines.join(splits, ["source_file", "block"])
    outside = F.coalesce(F.col("before"), F.col("turned_before").bitwiseXOR(F.col("entry"))) == 0
    first = outside & ~blank
    lines = lines.where(~(outside & blank)).withColumn("record", F.col("earlier") + F.sum(first.cast("int")).over(order))
    return lines.select("source_file", "record", F.struct("block", "at").alias("at"), "line")


def cells(record: Column) -> Column:
    """The cells of a record, null where nothing stands; quotes are taken off."""

    def cell(t: Column) -> Column:
        t = F.regexp_replace(t, r"\A,", "")
        bare = F.replace(F.regexp_replace(t, r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?+(.*)\z', "$1$2"), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(F.startswith(t, F.lit('"')), bare).otherwise(t), F.lit(""))

    return F.transform(F.regexp_extract_all(record, F.lit(_CELL), F.lit(0)), cell)


def names(header: Column) -> Column:
    """Distinct names of a header's cells: blank ones by their place, a repeated one with a number."""
    named = F.transform(header, lambda x, k: F.coalesce(x, F.concat(F.lit("Unnamed: "), k.cast("string"))))

    def distinct(x: Column, k: Column) -> Column:
        n = F.size(F.filter(F.slice(named, F.lit(1), k), lambda y: y == x))
        return F.when(n == 0, x).otherwise(F.concat(x, F.lit("."), n.cast("string")))

    return F.transform(named, distinct)


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, record, cells: each file's records from 1, the header."""
    lines = numbered(spark, paths)
    whole = lines.groupBy("source_file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"\A\x{FEFF}", "")
    return whole.select("source_file", "record", cells(text).alias("cells"))
