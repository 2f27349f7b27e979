"""Sessions, tenors, expiry regimes and rolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(days: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days in order, numbered from 0. One window over the calendar: a row per day, whatever the tables hold."""
    return days.select(F.col(day).cast("date").alias("day")).distinct().withColumn("session", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))


def weekend_sessions(calendar: DataFrame) -> DataFrame:
    """Saturdays and Sundays that were sessions; the first of February is the budget's, others are special."""
    weekend = calendar.filter(F.weekday("day") >= 5)
    kind = F.when((F.month("day") == 2) & (F.dayofmonth("day") == 1), "union_budget").otherwise("special_session")
    return weekend.select("day", "session", F.weekday("day").cast("int").alias("wd"), kind.alias("classification"))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days of one calendar only, and which one."""
    left = a.join(b, "day", "left_anti").select("day", F.lit("a_only").alias("side"))
    return left.unionByName(b.join(a, "day", "left_anti").select("day", F.lit("b_only").alias("side")))


def tenor(panel: DataFrame) -> DataFrame:
    """Weekly, monthly or long-dated. An expiry is its month's if it is the last one listed that day for its symbol and month."""
    month = [F.year("expiry").alias("y"), F.month("expiry").alias("m")]
    with_month = panel.select("*", *month)
    last = F.max("expiry").over(Window.partitionBy("trade_date", "symbol", "y", "m"))
    out = (F.col("y") - F.year("trade_date")) * 12 + F.col("m") - F.month("trade_date")
    kind = F.when(F.col("expiry") < last, "weekly").when(out <= 2, "monthly").otherwise("long_dated")
    return with_month.withColumn("tenor", kind).drop("y", "m")


def own_session_expiries(panel: DataFrame) -> DataFrame:
    """Expiries quoted on their own day; a re-dated contract's old date never is."""
    return panel.filter("trade_date = expiry").select("symbol", "expiry").distinct()


def weekday_runs(expiries: DataFrame) -> DataFrame:
    """Maximal runs of expiries on one weekday, by symbol."""
    order = Window.partitionBy("symbol").orderBy("expiry")
    changed = F.coalesce((F.col("wd") != F.lag("wd").over(order)).cast("int"), F.lit(0))
    runs = expiries.withColumn("wd", F.weekday("expiry")).withColumn("run", changed)
    runs = runs.withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "run", "wd").agg(F.min("expiry").alias("start"), F.max("expiry").alias("end"), F.count("*").alias("n"))


def month_last(expiries: DataFrame) -> DataFrame:
    """Whether an expiry is its month's last, and the last before it that is not."""
    by = Window.partitionBy("symbol", F.year("expiry"), F.month("expiry"))
    flagged = expiries.withColumn("is_last", F.col("expiry") == F.max("expiry").over(by))
    return flagged.withColumn("last_weekly", F.max(F.when(~F.col("is_last"), F.col("expiry"))).over(by))


def changed_sets(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The first moment, and each at which the set of values differs from the moment before."""
    sets = rows.groupBy(key, at).agg(F.array_sort(F.collect_set(value)).alias("members"))
    before = F.lag("members").over(Window.partitionBy(key).orderBy(at))
    return sets.withColumn("before", before).filter("before is null or members <> before").select(key, at, F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def days_early(expiry_weekday: Column, regime_weekday: Column) -> Column:
    return F.pmod(regime_weekday - expiry_weekday, F.lit(7)).cast("int")


def rolls(expiries: DataFrame, regimes: DataFrame) -> DataFrame:
    """Expiries off their regime's weekday, how many days early, and whether that is a roll back over a holiday (at most 3)."""
    wd = F.weekday("expiry")
    inside = (F.col("e.symbol") == F.col("r.symbol")) & F.col("e.expiry").between(F.col("r.start"), F.col("r.end"))
    joined = expiries.alias("e").join(F.broadcast(regimes).alias("r"), inside)
    off = joined.select("e.symbol", "e.expiry", wd.cast("int").alias("wd"), F.col("r.regime_wd").cast("int").alias("regime_wd"), days_early(wd, F.col("r.regime_wd")).alias("days_early"))
    return off.filter("days_early > 0").withColumn("kind", F.when(F.col("days_early") <= 3, "backward_roll").otherwise("off_cycle"))


def segments_sql(expiries: str, least: int = 5, gain: int = 3, spark: bool = True) -> str:
    """Tables of a recursive query that cuts each symbol's expiries (symbol, expiry, wd, i from 1) again and again; ``sg`` has symbol, lo, hi: expiries lo + 1 to hi.

    A row is a segment with its best cut, null once no cut sets right ``gain`` expiries, and carries its symbol's running counts of
    weekdays, one array as long as its expiries, so that a segment's cuts are weighed by look-ups. The two dialects differ in how lists are written.
    """
    at = (lambda k: f"p[CAST({k} AS INT)]") if spark else (lambda k: f"p[{k} + 1]")
    days = [f"c{w}" for w in range(7)]
    row = "named_struct('i', i, " + ", ".join(f"'{c}', {c}" for c in days) + ")" if spark else "{'i': i, " + ", ".join(f"'{c}': {c}" for c in days) + "}"
    collected = f"sort_array(collect_list({row}))" if spark else f"list({row} ORDER BY i)"

    def off(lo: str, hi: str) -> str:
        return f"({hi} - {lo} - greatest({', '.join(f'{at(hi)}.{c} - {at(lo)}.{c}' for c in days)}))"

    weighed = f"({off('lo', 'k')} + {off('k', 'hi')}) * 1000000 + k"
    first, last = f"lo + {least}", f"hi - {least}"
    costs = f"array_min(transform(sequence({first}, {last}), k -> {weighed}))" if spark else f"list_min(list_transform(range({first}, {last} + 1), lambda k: {weighed}))"
    best = f"CASE WHEN hi - lo >= {2 * least} THEN {costs} END"
    # ties to the first cut: costs are whole numbers, told apart by the cut
    cut = f"CASE WHEN {off('lo', 'hi')} - floor(best / 1000000e0) >= {gain} THEN best % 1000000 END"
    both = "explode(array(named_struct('lo', lo, 'hi', cut), named_struct('lo', cut, 'hi', hi)))" if spark else "unnest([{'lo': lo, 'hi': cut}, {'lo': cut, 'hi': hi}])"
    of = lambda source: f"SELECT symbol, p, lo, hi, {cut} AS cut FROM (SELECT symbol, p, lo, hi, {best} AS best FROM ({source}) a) b"
    counts = ", ".join(f"CAST(sum(CASE WHEN wd = {w} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) AS BIGINT) AS c{w}" for w in range(7))
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS c{w}" for w in range(7))
    return f"""rc AS (SELECT symbol, CAST(i AS BIGINT) AS i, {counts} FROM {expiries} UNION ALL SELECT DISTINCT symbol, CAST(0 AS BIGINT), {zeros} FROM {expiries}),
    rp AS (SELECT symbol, {collected} AS p, CAST(0 AS BIGINT) AS lo, max(i) AS hi FROM rc GROUP BY symbol),
    sq(symbol, p, lo, hi, cut) AS ({of('SELECT symbol, p, lo, hi FROM rp')}
      UNION ALL {of(f'SELECT symbol, p, z.lo AS lo, z.hi AS hi FROM (SELECT symbol, p, {both} AS z FROM sq WHERE cut IS NOT NULL) y')}),
    sg AS (SELECT symbol, lo, hi FROM sq WHERE cut IS NULL)"""


def regimes(expiries: DataFrame, least: int = 5, gain: int = 3) -> DataFrame:
    """All weekday regimes of each symbol: symbol, regime_wd, start, end, n.

    Best cuts repeat within each segment until none sets right ``gain`` expiries, in one recursive query; then neighbours of one weekday merge.
    A symbol's expiries are a row a date of its calendar.
    """
    order = Window.partitionBy("symbol").orderBy("expiry")
    numbered = expiries.select("symbol", "expiry").distinct().withColumns({"wd": F.weekday("expiry").cast("long"), "i": F.row_number().over(order).cast("long")})
    segments = expiries.sparkSession.sql(f"WITH RECURSIVE {segments_sql('{e}', least, gain)} SELECT symbol, lo, hi FROM sg", e=numbered)
    inside = numbered.alias("e").join(F.broadcast(segments).alias("s"), (F.col("e.symbol") == F.col("s.symbol")) & (F.col("i") > F.col("lo")) & (F.col("i") <= F.col("hi"))).select("e.symbol", "expiry", "wd", "lo")
    counted = inside.groupBy("symbol", "lo", "wd").agg(F.count("*").alias("c"), F.min("expiry").alias("first"), F.max("expiry").alias("last"))
    # the commonest weekday; ties to the one that comes first
    top = counted.groupBy("symbol", "lo").agg(F.min_by("wd", F.struct(-F.col("c"), F.col("first"))).alias("regime_wd"), F.sum("c").alias("n"), F.min("first").alias("a"), F.max("last").alias("b"))
    by_start = Window.partitionBy("symbol").orderBy("a")
    new = F.coalesce((F.col("regime_wd") != F.lag("regime_wd").over(by_start)).cast("int"), F.lit(0))
    runs = top.withColumn("new", new).withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "run", "regime_wd").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.sum("n").alias("n")).drop("run")
