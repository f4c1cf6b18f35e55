"""Parsing model replies held as table rows.

Each reply is one row; parsing is per-row built-in string/array functions, so
the work is spread by Spark like any projection.  Parse failures never fail
the job: they become NULL values and a rejects output (Q27).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reply patterns of the reference.
FORECAST = r"Forecast:\s*\[(.*?)\]"
NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
# The characters that a trim of text removes (all Unicode white space, and the byte order mark).
WHITESPACE = (" \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def _growth_pattern(label: str, strict: bool) -> str:
    return rf"{label}:\s*([\d.]+)%" if strict else rf"{label}:\s*([+-]?\d+\.?\d*)%"


def trim_ws(c: Column) -> Column:
    """Trim of all white space, no-break spaces included (Spark ``trim`` only strips spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def nonempty(c: Column) -> Column:
    """``regexp_extract`` yields '' for no match; make it NULL."""
    return F.when(c != "", c)


def parse_forecast(text: Column) -> Column:
    """``Forecast: [v1, v2, ...]`` -> ARRAY<DOUBLE>; NULL when absent, NULL elements when unparsable."""
    body = nonempty(F.regexp_extract(text, FORECAST, 1))
    return F.transform(F.split(body, ","), lambda x: trim_ws(x).try_cast("double"))


def explode_forecast(df: DataFrame, keys: list[str], text: str = "text", horizon: int = 5) -> DataFrame:
    """Forecast list as rows (key..., step, value) plus a ``complete`` flag (Q16)."""
    arr = parse_forecast(F.col(text))
    return (df.select(*keys, arr.alias("_f"))
            .where(F.col("_f").isNotNull())
            .select(*keys, F.posexplode("_f").alias("pos", "value"), (F.size("_f") == horizon).alias("complete"))
            .select(*keys, (F.col("pos") + 1).alias("step"), "value", "complete"))


def forecast_rejects(df: DataFrame, text: str = "text") -> DataFrame:
    """Q27: replies without a parsable forecast list."""
    f = parse_forecast(F.col(text))
    return df.where(f.isNull() | F.exists(f, lambda x: x.isNull()))


def parse_growth(text: Column, label: str, strict: bool = False) -> Column:
    """``<label>: X%`` -> X/100; NULL when absent. ``strict`` reproduces the unsigned EBIT pattern (Q26)."""
    v = nonempty(F.regexp_extract(text, _growth_pattern(label, strict), 1))
    return v.try_cast("double") / F.lit(100.0)


def parse_number(text: Column) -> Column:
    """A reply that is one number (white space around it aside) as a double; anything else is NULL, see ``number_rejects``."""
    bare = trim_ws(text)
    return F.when(bare.rlike(f"^(?:{NUMBER})$"), bare.try_cast("double"))


def number_rejects(df: DataFrame, text: str = "text") -> DataFrame:
    """Replies that are no bare number."""
    return df.where(parse_number(F.col(text)).isNull())


def table_lines(text: Column) -> Column:
    """Lines of the trimmed reply that contain a pipe."""
    return F.filter(F.split(trim_ws(text), "\n"), lambda ln: F.instr(ln, "|") > 0)


def cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), trim_ws), lambda c: c != "")


def table_parts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per reply with a table: its header cells ``header`` and body rows ``body`` (arrays of cells).

    First pipe line is the header, the second is skipped, cells are trimmed and empty
    ones dropped; a body row stays only with as many cells as headers, the header stays
    without any; fewer than three pipe lines are no table.
    """
    # exploding an array of one keeps Spark from computing these again for each column that uses them
    t = df.select(*keys, F.explode(F.array(table_lines(F.col(text)))).alias("_tl")).where(F.size("_tl") >= 3)
    t = t.select(*keys, F.explode(F.array(F.transform("_tl", cells))).alias("_cells"))
    head = F.element_at("_cells", 1)
    kept = F.filter(F.transform(F.slice("_cells", 3, F.size("_cells") - 2), lambda c, i: F.struct((i + 2).alias("row_no"), c.alias("cells"))),
                    lambda r: F.size(r["cells"]) == F.size(head))
    return t.select(*keys, head.alias("header"), kept.alias("body"))


def parse_pipe_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Pipe table -> (key..., row_no, col_no, header, cell)."""
    t = table_parts(df, keys, text).select(*keys, "header", F.explode("body").alias("r"))
    return t.select(*keys, F.col("r.row_no").alias("row_no"), F.posexplode(F.arrays_zip(F.col("header"), F.col("r.cells").alias("cell")))
                    .alias("col_no", "hc")).select(*keys, "row_no", "col_no", "hc.header", "hc.cell")


def csv_lines(df: DataFrame, keys: list[str], header_start: str, schema: str, text: str = "text") -> DataFrame:
    """The lines after the CSV header of a reply, up to the closing fence or a blank line (Q29):
    ``keys, row_no, line, fields`` with ``fields`` parsed by ``schema`` and ``_corrupt`` in it for a line that does not fit.
    """
    lines = F.split(F.col(text), r"\r?\n")
    t = df.select(*keys, lines.alias("_l"))
    first = F.array_position(F.transform("_l", lambda x: F.instr(x, header_start) > 0), True).cast("int")
    t = t.where(first > 0).select(*keys, F.slice("_l", first + 1, F.size("_l")).alias("_l"))
    stop = F.array_position(F.transform("_l", lambda x: x.startswith("```") | (trim_ws(x) == "")), True).cast("int")
    t = t.select(*keys, F.when(stop > 0, F.slice("_l", 1, stop - 1)).otherwise(F.col("_l")).alias("_l"))
    t = t.select(*keys, F.posexplode("_l").alias("_p", "line"))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return t.select(*keys, (F.col("_p") + 1).alias("row_no"), "line", F.from_csv("line", f"{schema}, _corrupt STRING", opts).alias("fields"))


def extract_csv(df: DataFrame, keys: list[str], header_start: str, schema: str, text: str = "text") -> DataFrame:
    """The CSV rows of a reply that fit ``schema`` (quoted cells may hold commas)."""
    rows = csv_lines(df, keys, header_start, schema, text).where(F.col("fields._corrupt").isNull())
    return rows.select(*keys, "row_no", "fields.*").drop("_corrupt")


def csv_rejects(df: DataFrame, keys: list[str], header_start: str, schema: str, text: str = "text") -> DataFrame:
    """Q27: lines of the block that do not fit ``schema``; the rows after them are still read."""
    return csv_lines(df, keys, header_start, schema, text).where(F.col("fields._corrupt").isNotNull()).select(*keys, "row_no", "line")


def with_default(body: Column, path: str, default: str) -> Column:
    """A JSON request field with a default when the request lacks it."""
    return F.coalesce(F.get_json_object(body, path), F.lit(default))
