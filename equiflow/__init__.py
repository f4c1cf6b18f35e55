"""equiflow: Spark-native equity screening, indicator and valuation engine.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function that works on all tickers at once.  Nothing is collected to the
driver; per-ticker work is partitioned by ``ticker`` (and by a row block for
long series, see ``operators.series``).
"""
