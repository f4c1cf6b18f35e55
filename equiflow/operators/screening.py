"""Screening: ticker votes over repeated replies, factor scores, top-k, sampling
(X01 A01-A04 T02-T05 C01-C03 J03 P01 P02 S08).

Vote counting is a ``groupBy`` with map-side combine, so a request that holds
a third of all replies is pre-aggregated in every task before the shuffle.
Top-k per group uses ``row_number() <= k``, which Spark plans with a partial
window-group limit before the exchange.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiflow.operators.numbering import numbered
from equiflow.operators.series import order_bucket
from equiflow.sources.tables import shared

# Line breaks of Python ``str.splitlines`` and the pipe-row ticker pattern.
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"
TICKER_ROW = r"(?U)^\|\s*([A-Z]{1,5})\s*\|"
UNKNOWN_COMPANY = "Unknown Company"
LINES_AT_MOST = 1 << 32  # an array index fits


def lines(text: Column) -> Column:
    """Split into lines like ``splitlines``."""
    return F.split(text, LINE_BREAK)


def extract_tickers(replies: DataFrame, text: str = "text",
                    keys: tuple[str, ...] = ("request_id", "reply_id")) -> DataFrame:
    """One row per pipe-table line whose first cell is a 1-5 letter upper-case symbol."""
    exploded = replies.select(*keys, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    sym = F.regexp_extract(F.col("line"), TICKER_ROW, 1)
    return exploded.select(*keys, "line_no", sym.alias("symbol")).where(F.col("symbol") != "")


def count_votes(tickers: DataFrame, group: str = "request_id") -> DataFrame:
    """Votes per (request, symbol) and the first position seen (reply order, line).

    The position is one number, so hash aggregates hold it and no task sorts its symbols.
    """
    width = F.lit(LINES_AT_MOST).cast("decimal(11,0)")
    place = F.col("reply_id").cast("decimal(20,0)") * width + F.col("line_no")
    votes = tickers.groupBy(group, "symbol").agg(F.count(F.lit(1)).alias("votes"), F.min(place).alias("first_seen"))
    line = F.pmod("first_seen", width)
    return votes.withColumns({"first_line_no": line.cast("int"), "first_reply_id": ((F.col("first_seen") - line) / width).cast("long")})


def top_voted(votes: DataFrame, k: int = 3, group: str = "request_id") -> DataFrame:
    """Top ``k`` by votes, ties broken by first appearance."""
    w = Window.partitionBy(group).orderBy(F.col("votes").desc(), F.col("first_seen"))
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def attempts(replies: DataFrame, group: str = "request_id") -> DataFrame:
    return replies.groupBy(group).agg(F.count(F.lit(1)).alias("attempts"))


def vote_share(votes: DataFrame, tries: DataFrame, group: str = "request_id") -> DataFrame:
    """Votes / attempts of the request (answer stability)."""
    return votes.join(tries, group).withColumn("vote_share", F.col("votes") / F.col("attempts"))


def name_lookup(symbols: DataFrame, universe: DataFrame, symbol: str = "symbol", name: str = "name") -> DataFrame:
    """Left join to the universe with the 'Unknown Company' default."""
    return (symbols.join(universe.select(F.col(symbol), F.col(name)), symbol, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(UNKNOWN_COMPANY))))


def keep_members(universe: DataFrame, winners: DataFrame, on: str = "symbol") -> DataFrame:
    """The universe rows of each request's winners, with request and rank; a winner outside the universe has none."""
    return winners.join(universe, on)


def consistent_top3(replies: DataFrame, universe: DataFrame, k: int = 3) -> DataFrame:
    """Replies -> tickers -> votes -> top k -> companies, for all requests at once."""
    winners = top_voted(count_votes(extract_tickers(replies)), k)
    return name_lookup(winners, universe).select("request_id", "rank", "symbol", "name", "votes")


def screen_sector(df: DataFrame, sector: str, cols: list[str], sector_col: str = "sector") -> DataFrame:
    """Equality filter plus column subset (pushed into the scan)."""
    return df.where(F.col(sector_col) == sector).select(*cols)


def total_score(df: DataFrame, factors: list[str], weights: list[float] | None = None) -> Column:
    """Sum of factor scores, each clamped to 0..5; NULL when a factor is missing."""
    weights = weights or [1] * len(factors)
    parts = [F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), F.lit(0)), F.lit(5))) * F.lit(w) for f, w in zip(factors, weights)]
    return reduce(add, parts)


def percent_ranks(df: DataFrame, col: str, group: str, ascending: bool = True, out: str = "percent_rank") -> DataFrame:
    """``percent_rank`` of the non-NULL values of ``col`` in each group, without one task per group.

    Equal values are counted together (in the map tasks first) and ranked inside value
    buckets; only the buckets' totals, a bounded table, meet per group.
    """
    df = shared(df.withColumn("_bucket", order_bucket(df, col)))
    counts = df.where(F.col(col).isNotNull()).groupBy(group, "_bucket", col).agg(F.count(F.lit(1)).alias("_n"))
    direction = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(group, "_bucket").orderBy(direction(col)).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(group, "_bucket").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(group).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(group)).alias("_all"))
    ranks = counts.withColumn("_less", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, [group, "_bucket"])
    share = F.when(F.col("_all") > 1, (F.col("_before") + F.col("_less")) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    ranks = ranks.select(F.col(group).alias("_g"), F.col(col).alias("_v"), share.alias(out))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & (F.col(col) == F.col("_v")), "left").drop("_g", "_v", "_bucket")


def factor_score(df: DataFrame, col: str, group: str = "sector", higher_is_better: bool = True,
                 out: str | None = None) -> DataFrame:
    """0-5 score of a raw measure within its group by percent rank; NULL measures have none."""
    ranked = percent_ranks(df, col, group, higher_is_better, "_pr")
    return ranked.withColumn(out or f"{col}_score", F.round(F.col("_pr") * 5, 0).cast("int")).drop("_pr")


def top_scored(df: DataFrame, k: int = 3, score: str = "total_score", tie: str = "ticker",
               group: str | None = None) -> DataFrame:
    """Top ``k`` by score (ties by ``tie``), globally or per ``group``."""
    if group is None:
        return df.orderBy(F.col(score).desc(), F.col(tie)).limit(k)
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def factor_screen(scores: DataFrame, factors: list[str], k: int = 3, group: str | None = None) -> DataFrame:
    """Score table -> total -> top k."""
    return top_scored(scores.withColumn("total_score", total_score(scores, factors)), k, group=group)


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Fixed-order head (repeatable screening input)."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """Repeatable sample of ``n`` rows: order by md5(key || seed)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)).limit(n)


def with_row_id(df: DataFrame, order: str | list[str], out: str = "row_id") -> DataFrame:
    """Dense 0-based row number over the whole frame in the order of one or more columns, NULLs first.

    Rows are numbered inside sorted ranges of sampled borders (``numbering.numbered``): as even for text, dates of
    one year or huge ids as for small numbers.  Where the columns leave ties, name one that breaks them.
    """
    return numbered(df, [F.asc_nulls_first(c) for c in ([order] if isinstance(order, str) else order)], out)


def rank_columns_by_total(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column totals, largest first (``unpivot`` + ``groupBy``)."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "metric", "value")
    tot = long.groupBy("metric").agg(F.sum("value").alias("total"))
    return tot.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "metric")))
