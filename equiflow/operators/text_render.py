"""Rendering tables and numbers as text.

Texts are built per group (per ticker, per reply): lines are joined in blocks, then the blocks of a group,
or the blocks are returned as they are.  A whole table is never turned into one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiflow.operators.quantiles import exact_quantiles
from equiflow.operators.text_parse import nonempty

NOT_PROVIDED = "NOT PROVIDED"


# ---- X12: number formats ----

def fmt_money(c: Column) -> Column:
    """``$1,234`` (no decimals)."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def fmt_pct(c: Column, digits: int = 1) -> Column:
    """``12.3%`` from a fraction."""
    return F.format_string(f"%.{digits}f%%", c * 100)


def fmt_mult(c: Column) -> Column:
    return F.format_string("%.1fx", c)


def fmt_or(c: Column, formatted: Column, default: str = NOT_PROVIDED) -> Column:
    return F.when(c.isNull(), F.lit(default)).otherwise(formatted)


# ---- X13: labelled breakdown ----

RATE, MONEY, RATIO = "rate", "money", "ratio"


def render_breakdown(df: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One ``label: value`` row per breakdown field; ``fields``: label -> (column, kind of number)."""
    formats = {RATE: lambda c: fmt_pct(c, 2), MONEY: fmt_money, RATIO: lambda c: F.format_string("%.2f", c)}
    lines = []
    for label, (source, kind) in fields.items():
        c = F.col(source).cast("double")
        lines.append(F.concat(F.lit(f"{label}: "), fmt_or(c, formats[kind](c), "N/A")))
    return df.select(key, F.posexplode(F.array(*lines)).alias("pos", "line"))


# ---- A08 / X09-X11: tables to text, per group ----

#: Lines that are joined in one place before a group is.
LINE_BLOCK = 1000


def _join_lines(df: DataFrame, group: list[str], order: str, line: str, sep: str = "\n", blocks: bool = False) -> DataFrame:
    """Ordered lines of a group as one text value, joined block by block.

    With ``blocks`` the blocks themselves, ``group, block, text``, in order: no value holds more than ``LINE_BLOCK`` order
    numbers, however large the group.
    """
    def joined(rows: DataFrame, keys: list[str], o: str, text: str) -> DataFrame:
        agg = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(text).alias("l")))).alias("_ls"))
        return agg.select(*keys, F.array_join(F.transform("_ls", lambda x: x["l"]), sep).alias("text"))

    parts = joined(df.withColumn("block", F.floor(F.col(order) / LINE_BLOCK)), [*group, "block"], order, line)
    return parts if blocks else joined(parts, group, "block", "text")


def _with_widths(s: DataFrame, group: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_w_<col>``, the length of each column's longest cell or name in the group, and these widths by group.

    Widths are a partial aggregate joined back: a large group is never held together.
    """
    widths = s.groupBy(*group).agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"_w_{c}") for c in cols])
    own = widths.withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return s.join(own, same).drop(*[f"_g_{g}" for g in group]), widths


def render_pipe_table(df: DataFrame, group: list[str], order: str, cols: list[str], blocks: bool = False) -> DataFrame:
    """X11: fixed-width pipe table per group; each column as wide as its longest cell or header."""
    s = df.select(*group, order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    s, head = _with_widths(s, group, cols)

    def row(vals):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *vals), F.lit(" |"))

    body = s.select(*group, (F.col(order).cast("long") + 2).alias("_o"),
                    row([F.rpad(F.col(c), F.col(f"_w_{c}"), " ") for c in cols]).alias("line"))
    header = head.select(*group, F.lit(0).cast("long").alias("_o"),
                         row([F.rpad(F.lit(c), F.col(f"_w_{c}"), " ") for c in cols]).alias("line"))
    sep = head.select(*group, F.lit(1).cast("long").alias("_o"),
                      F.concat(F.lit("|"), F.concat_ws("|", *[F.repeat(F.lit("-"), F.col(f"_w_{c}") + 2)
                                                             for c in cols]), F.lit("|")).alias("line"))
    return _join_lines(header.unionByName(sep).unionByName(body), group, "_o", "line", blocks=blocks)


def render_table(df: DataFrame, group: list[str], order: str, cols: list[str], blocks: bool = False) -> DataFrame:
    """Right-aligned text block per group without index, columns separated by two spaces."""
    s = df.select(*group, order, *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in cols])
    s, widths = _with_widths(s, group, cols)
    body = s.select(*group, (F.col(order).cast("long") + 1).alias("_o"),
                    F.concat_ws("  ", *[F.lpad(F.col(c), F.col(f"_w_{c}"), " ") for c in cols]).alias("line"))
    head = widths.select(
        *group, F.lit(0).cast("long").alias("_o"),
        F.concat_ws("  ", *[F.lpad(F.lit(c), F.col(f"_w_{c}"), " ") for c in cols]).alias("line"))
    return _join_lines(head.unionByName(body), group, "_o", "line", blocks=blocks)


def render_csv(df: DataFrame, group: list[str], order: str, cols: list[str], header: list[str] | None = None) -> DataFrame:
    """CSV text per group; cells with commas, quotes or line breaks are quoted, quotes doubled."""
    body = df.select(*group, (F.col(order).cast("long") + 1).alias("_o"), F.concat_ws(",", *[csv_cell(F.col(c)) for c in cols]).alias("line"))
    head = df.select(*group).distinct().select(*group, F.lit(0).cast("long").alias("_o"),
                                               F.concat_ws(",", *[csv_cell(F.lit(c)) for c in header or cols]).alias("line"))
    return _join_lines(head.unionByName(body), group, "_o", "line")


def csv_cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text)


def html_text(c: Column) -> Column:
    """Text safe inside an element."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def to_html_rows(tables: DataFrame, keys: list[str], caption: str | None = None) -> DataFrame:
    """Tables (``text_parse.table_parts``) -> HTML table text per reply, header kept even without a body row.

    Each reply is one row in and one row out: arrays are joined in place, nothing is dealt.
    """
    def row(items, tag):
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(items, lambda c: F.concat(F.lit(f"<{tag}>"), html_text(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    title = F.lit("" if caption is None else f"<caption>{caption}</caption>")
    body = F.array_join(F.transform("body", lambda r: row(r["cells"], "td")), "")
    return tables.select(*keys, F.concat(F.lit("<table>"), title, F.lit("<thead>"), row(F.col("header"), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>")).alias("html"))


#: The line under a pipe table's header.
TABLE_RULE = r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"


def bullet_groups(df: DataFrame, keys: list[str], row: str, text: str = "text") -> DataFrame:
    """``keys, symbol, name, bullets``, one row per symbol of a reply's table.

    ``row`` takes symbol, name and bullet out of a line after the table's rule.  A line without symbol (or name)
    belongs to the one above: both are carried down inside the reply's array of lines, so nothing is dealt.  A symbol that
    comes again goes on with its own bullets.  The name is that of the symbol's first line.
    """
    lines = df.select(*keys, F.explode(F.array(F.split(text, "\n"))).alias("_l"))
    rule = F.array_position(F.transform("_l", lambda x: x.rlike(TABLE_RULE)), True).cast("int")
    part = lambda x, i: F.regexp_extract(x, row, i)
    below = lines.withColumn("_r", rule).where("_r > 0").select(*keys, F.filter(F.transform(
        F.slice("_l", F.col("_r") + 1, F.size("_l")), lambda x: F.struct(nonempty(part(x, 1)).alias("symbol"), nonempty(part(x, 2)).alias("name"), part(x, 3).alias("bullet"))),
        lambda r: r["bullet"] != "").alias("_rows"))
    none, kind = F.lit(None).cast("string"), "array<struct<symbol:string,name:string,bullet:string>>"

    def carry(seen, r):
        symbol, name = F.coalesce(r["symbol"], seen["symbol"]), F.coalesce(r["name"], seen["name"])
        return F.struct(symbol.alias("symbol"), name.alias("name"), F.concat(seen["rows"], F.array(F.struct(symbol.alias("symbol"), name.alias("name"), r["bullet"].alias("bullet")))).alias("rows"))

    start = F.struct(none.alias("symbol"), none.alias("name"), F.array().cast(kind).alias("rows"))
    full = below.select(*keys, F.explode(F.array(F.aggregate("_rows", start, carry, lambda seen: seen["rows"]))).alias("_rows"))
    each = full.select(*keys, "_rows", F.explode(F.array_distinct(F.transform("_rows", lambda r: r["symbol"]))).alias("symbol"))
    own = each.select(*keys, "symbol", F.filter("_rows", lambda r: r["symbol"].eqNullSafe(F.col("symbol"))).alias("_own"))
    return own.select(*keys, "symbol", F.element_at("_own", 1)["name"].alias("name"), F.transform("_own", lambda r: r["bullet"]).alias("bullets"))


def explode_bullets(df: DataFrame, keys: list[str], max_bullets: int | None = None) -> DataFrame:
    """(symbol, name, bullets) -> continuation rows, symbol and name only on the first; all bullets.

    With ``max_bullets`` the first so many rows, each with the number left out in ``more``.
    """
    bullets = F.col("bullets") if max_bullets is None else F.slice("bullets", 1, max_bullets)
    more = F.size("bullets") - F.size(bullets)
    t = df.select(*keys, "symbol", "name", more.alias("more"), F.posexplode(bullets).alias("pos", "bullet"))
    first = F.col("pos") == 0
    return t.select(*keys, "pos", F.when(first, F.col("symbol")).otherwise(F.lit("")).alias("symbol_cell"),
                    F.when(first, F.col("name")).otherwise(F.lit("")).alias("name_cell"), "bullet", "more")


# ---- A09: numeric profile ----

PROFILE_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, stddev, min, quartiles and max per column, one row each.

    Quartiles are the elements of rank ceil(p * count), found by counting (``quantiles.exact_quantiles``).  Runs
    its passes while the query is built; the driver holds the figures of each column.
    """
    kinds = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{k}") for n, c in enumerate(cols) for k, f in kinds.items()]).first()
    quartiles = exact_quantiles(df, cols, list(PROFILE_QUARTILES.values()), {c: one[f"{n}_count"] for n, c in enumerate(cols)})
    rows = [(c, *[one[f"{n}_{k}"] for k in ("count", "mean", "stddev", "min")], *quartiles[c], one[f"{n}_max"]) for n, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, stddev double, min double, p25 double, p50 double, p75 double, max double")
