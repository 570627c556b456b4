"""Diagnostics in build logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import ordered_case

# The formats of diagnostic lines, and bounds of their number and context.
CATEGORY = "(?:error|warning|message|suggestion)"
TSC_PAREN = rf"(?i)^(.+?)\((\d+),(\d+)\):\s*({CATEGORY})\s+(TS\d+):\s*(.*)$"
TSC_COLON = rf"(?i)^(.+?):(\d+):(\d+)\s+-\s*({CATEGORY})\s+(TS\d+):\s*(.*)$"
TSC_GLOBAL = rf"(?i)^({CATEGORY})\s+(TS\d+):\s*(.*)$"
VITE = r"(?i)^\[vite(?::[^\]]+)?\]:?\s*(.+)$"
ESBUILD = r"(?i)^(?:✘|x)\s+\[(ERROR|WARNING)\]\s*(.+)$"
LOCATION = r"^(.+?):(\d+):(\d+):\s*$"
RELATED_PAREN = r"^(.+?)\((\d+),(\d+)\):\s*(.+)$"
RELATED_COLON = r"^(.+?):(\d+):(\d+)\s+-\s*(.+)$"
IMPORT_SOURCE = r"""\bfrom\s+["']([^"']+)["']"""
READS_AS_ERROR = "error|failed|cannot|could not|rollup"
CONTEXT = r"^(\s|>|\||│|╵|~|\^)"
MAX_DIAGNOSTICS, MAX_CONTEXT = 100, 30


def _struct(form: str, line: Column, pattern: str, path: int, category: Column, code: int, message: int) -> Column:
    get = lambda i: F.regexp_extract(line, pattern, i) if i else F.lit(None).cast("string")
    at = lambda i: F.regexp_extract(line, pattern, i).try_cast("int") if path else F.lit(None).cast("int")
    return F.struct(F.lit(form).alias("form"), get(path).alias("path"), at(2).alias("line"), at(3).alias("column"), F.lower(category).alias("category"), F.upper(get(code)).alias("code"), get(message).alias("message"))


def diagnostic(line: Column) -> Column:
    """A struct of form, path, line, column, category, code, message for a line that opens a diagnostic; null for others."""
    return ordered_case(
        [
            (line.rlike(TSC_PAREN), _struct("tsc", line, TSC_PAREN, 1, F.regexp_extract(line, TSC_PAREN, 4), 5, 6)),
            (line.rlike(TSC_COLON), _struct("tsc", line, TSC_COLON, 1, F.regexp_extract(line, TSC_COLON, 4), 5, 6)),
            (line.rlike(TSC_GLOBAL), _struct("tsc", line, TSC_GLOBAL, 0, F.regexp_extract(line, TSC_GLOBAL, 1), 2, 3)),
            (line.rlike(ESBUILD), _struct("esbuild", line, ESBUILD, 0, F.regexp_extract(line, ESBUILD, 1), 0, 2)),
            (line.rlike(VITE), _vite(line)),
        ]
    )


def _vite(line: Column) -> Column:
    """The path is what the message imports from; it is an error if it reads as one."""
    message = F.regexp_extract(line, VITE, 1)
    found = _struct("vite", line, VITE, 0, F.when(F.lower(message).rlike(READS_AS_ERROR), "error").otherwise("unknown"), 0, 1)
    return found.withField("path", F.nullif(F.regexp_extract(message, IMPORT_SOURCE, 1), F.lit("")))


def related(line: Column) -> Column:
    """A struct of path, line, column, message, code for a line that tells of another place of a diagnostic; null for others."""
    pattern = lambda p: F.struct(
        F.regexp_extract(line, p, 1).alias("path"), F.regexp_extract(line, p, 2).try_cast("int").alias("line"), F.regexp_extract(line, p, 3).try_cast("int").alias("column"), F.regexp_extract(line, p, 4).alias("message"),
        F.nullif(F.regexp_extract(F.regexp_extract(line, p, 4), r"\b(TS\d+)\b", 1), F.lit("")).alias("code"),
    )
    return ordered_case([(line.rlike(RELATED_PAREN), pattern(RELATED_PAREN)), (line.rlike(RELATED_COLON), pattern(RELATED_COLON))])


def _opens(line: Column) -> Column:
    """Whether ``diagnostic`` is not null."""
    return line.rlike("|".join(f"(?:{p})" for p in (TSC_PAREN, TSC_COLON, TSC_GLOBAL, ESBUILD, VITE)))


def _tells(line: Column) -> Column:
    """Whether ``related`` is not null."""
    return line.rlike(RELATED_PAREN) | line.rlike(RELATED_COLON)


def _lines(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, line, bare) of the lines that are not blank: without the blanks at their end, and without those at both ends."""
    raw = F.coalesce(F.col("line").cast("string"), F.lit(""))
    return lines.select("log_id", "line_no", F.regexp_replace(raw, r"\s+$", "").alias("line"), F.regexp_replace(raw, r"^\s+|\s+$", "").alias("bare")).where("bare <> ''")


def _numbered(rows: DataFrame) -> DataFrame:
    """Lines with the number of their diagnostic, which those that ``opens`` begin. The hundredth has its first line only."""
    order = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("number", F.count(F.when(F.col("opens"), 1)).over(order)).where(F.col("number").between(1, MAX_DIAGNOSTICS) & ((F.col("number") < MAX_DIAGNOSTICS) | F.col("opens")))


def _marked(lines: DataFrame) -> DataFrame:
    """Lines of diagnostics with their number: ``d`` opens one, ``r`` tells of another place, ``place`` is a bare location."""
    # What a line tells is read from it after the sort, so that no row is sorted with it.
    rows = _numbered(_lines(lines).withColumn("opens", _opens(F.col("bare"))))
    rows = rows.withColumn("d", F.when(F.col("opens"), diagnostic(F.col("bare")))).drop("opens")
    return rows.withColumns({"r": F.when(F.col("d").isNull(), related(F.col("bare"))), "place": F.col("d").isNull() & F.col("bare").rlike(LOCATION)})


def related_information(lines: DataFrame) -> DataFrame:
    """(log_id, number, nth, path, line, column, message, code): the other places of each diagnostic, in order, however many there are."""
    # Only lines that open a diagnostic, without their text, and those of other places are sorted, once: places are counted on from the last line that opens one.
    rows = _lines(lines).select("log_id", "line_no", "bare", _opens(F.col("bare")).alias("opens")).where(F.col("opens") | _tells(F.col("bare")))
    rows = _numbered(rows.select("log_id", "line_no", "opens", F.when(~F.col("opens"), F.col("bare")).alias("bare")))
    order = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    count = F.count("bare").over(order)
    rows = rows.withColumn("told", count).withColumn("before", F.max(F.when(F.col("opens"), F.col("told"))).over(order)).where("not opens")
    return rows.select("log_id", "number", (F.col("told") - F.col("before")).cast("int").alias("nth"), related(F.col("bare")).alias("r")).select("log_id", "number", "nth", "r.*")


def with_related(found: DataFrame, others: DataFrame) -> DataFrame:
    """Diagnostics with the list ``related`` of their other places."""
    listed = others.groupBy("log_id", "number").agg(F.array_sort(F.collect_list(F.struct("nth", "path", "line", "column", "message", "code"))).alias("related"))
    empty = F.array().cast(listed.schema["related"].dataType)
    return found.join(listed, ["log_id", "number"], "left").withColumn("related", F.coalesce("related", empty))


def diagnostics(lines: DataFrame) -> DataFrame:
    """(log_id, number, form, path, line, column, category, code, message, context) of (log_id, line_no, line).

    The lines after a diagnostic belong to it: those of other places are ``related_information``; the first bare location gives an esbuild diagnostic its place; indented
    lines and marks are its context, thirty at most. A log gives a hundred diagnostics at most.
    """
    marked = _marked(lines)
    head = Window.partitionBy("log_id", "number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("form", F.first("d.form", ignorenulls=True).over(head))
    rest = F.col("d").isNull() & F.col("r").isNull()
    nth_place = F.count(F.when(rest & F.col("place"), 1)).over(head)
    marked = marked.withColumn("at", rest & F.col("place") & (nth_place == 1) & (F.col("form") == "esbuild"))
    # Lines are counted before any is collected, so that a long log is no long array.
    marked = marked.withColumn("shown", rest & (F.col("at") | F.col("line").rlike(CONTEXT)))
    marked = marked.withColumn("nth", F.count(F.when(F.col("shown"), 1)).over(head))
    context = F.transform(F.array_sort(F.collect_list(F.when(F.col("shown") & (F.col("nth") <= MAX_CONTEXT), F.struct("line_no", "line")))), lambda c: c["line"])
    grouped = marked.groupBy("log_id", "number").agg(F.first("d", ignorenulls=True).alias("d"), context.alias("context"), F.max(F.when(F.col("at"), F.col("bare"))).alias("at"))
    placed = F.col("at").isNotNull()
    return grouped.select(
        "log_id",
        "number",
        "d.form",
        F.when(placed, F.regexp_extract("at", LOCATION, 1)).otherwise(F.col("d.path")).alias("path"),
        F.when(placed, F.regexp_extract("at", LOCATION, 2).try_cast("int")).otherwise(F.col("d.line")).alias("line"),
        F.when(placed, F.regexp_extract("at", LOCATION, 3).try_cast("int")).otherwise(F.col("d.column")).alias("column"),
        "d.category",
        "d.code",
        "d.message",
        "context",
    )
