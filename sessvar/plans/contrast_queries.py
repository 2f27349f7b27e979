"""Contrast queries: variance on expiry days over that on others with intervals, for an index by estimator and for stocks by contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import design
from ..operators import returns as r
from ..sources.fixtures import Views
from .pricing_queries import rounded
from .registry import query
from .returns_queries import EVENT, FRONT, ln_ratio

INDEX = "NFT"


def ratio_sql(values: str, *keys: str) -> str:
    """Ratios of resampled means and medians over a table ``values`` of keys, sample, value and tie, and their intervals."""
    one = ", ".join([*keys, "sample"])
    own = ", ".join(keys)
    same = lambda a, b, columns: " AND ".join(f"{a}.{c} = {b}.{c}" for c in columns)
    part = [*keys, "sample"]
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {one} ORDER BY value, tie) - 1 AS no, count(*) OVER (PARTITION BY {one}) AS n FROM {values}),
    pk AS (SELECT {one}, n, draw, CASE WHEN draw = 0 THEN no ELSE CAST(floor({uniform_sql("'ratio'", *part, 'draw', 'no')} * n) AS BIGINT) END AS pick FROM rk CROSS JOIN range(0, {design.RATIO_DRAWS + 1}) AS r(draw)),
    tm AS (SELECT {one}, n, draw, pick, count(*) AS times FROM pk GROUP BY ALL),
    ct AS (SELECT {', '.join(f'tm.{c}' for c in part)}, tm.n, draw, times, value, coalesce(sum(times) OVER (PARTITION BY {', '.join(f'tm.{c}' for c in part)}, draw ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tm JOIN rk ON {same('tm', 'rk', part)} AND rk.no = tm.pick),
    st AS (SELECT {one}, draw, sum(value * times) / sum(times) AS mean, (max(CASE WHEN before <= (n - 1) // 2 AND (n - 1) // 2 < before + times THEN value END) + max(CASE WHEN before <= n // 2 AND n // 2 < before + times THEN value END)) / 2 AS median FROM ct GROUP BY {one}, draw),
    rt2 AS (SELECT {own}, draw, max(CASE WHEN sample = 1 THEN mean END) / nullif(max(CASE WHEN sample = 0 THEN mean END), 0) AS mean, max(CASE WHEN sample = 1 THEN median END) / nullif(max(CASE WHEN sample = 0 THEN median END), 0) AS median FROM st GROUP BY {own}, draw),
    lg AS (SELECT {own}, draw, 'mean' AS stat, mean AS value FROM rt2 UNION ALL SELECT {own}, draw, 'median', median FROM rt2)
    SELECT {own}, stat, round(max(CASE WHEN draw = 0 THEN value END), 6) AS ratio, round(quantile_cont(value, 0.025) FILTER (WHERE draw > 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (WHERE draw > 0), 6) AS high,
      count(*) FILTER (WHERE draw > 0 AND value IS NULL) AS not_finite, NOT (quantile_cont(value, 0.025) FILTER (WHERE draw > 0) < 1 AND quantile_cont(value, 0.975) FILTER (WHERE draw > 0) > 1) AS apart FROM lg GROUP BY {own}, stat"""


@query("index_decomposition_ci", f"""WITH ex AS (SELECT DISTINCT expiry AS day FROM long_expiries WHERE symbol = '{INDEX}'), x AS (SELECT *, lag(close) OVER (ORDER BY session) AS before FROM long_daily WHERE index_name = '{INDEX}'),
    es AS (SELECT day, 'close_close' AS estimator, pow({ln_ratio('close', 'before')}, 2) AS value FROM x UNION ALL SELECT day, 'overnight', pow({ln_ratio('open', 'before')}, 2) FROM x
      UNION ALL SELECT day, 'open_close', pow({ln_ratio('close', 'open')}, 2) FROM x UNION ALL SELECT day, 'parkinson', pow({ln_ratio('high', 'low')}, 2) / (4 * ln(2e0)) FROM x),
    vs AS (SELECT CASE WHEN es.day < {EVENT} THEN 'pre' ELSE 'post' END AS part, estimator, CASE WHEN ex.day IS NULL THEN 0 ELSE 1 END AS sample, value, es.day AS tie FROM es LEFT JOIN ex ON ex.day = es.day WHERE value IS NOT NULL),
    {ratio_sql('vs', 'part', 'estimator')}""")
def index_decomposition_ci(v: Views) -> DataFrame:
    """Variance on expiry days over that on others, by estimator, before and after the regime change: means and medians with intervals."""
    expiries = v.long_expiries.filter(F.col("symbol") == INDEX).select(F.col("expiry").alias("day"))
    samples = design.index_samples(v.long_daily.filter(F.col("index_name") == INDEX), expiries, F.expr(EVENT))
    keys = ["part", "estimator"]
    return rounded(design.ratio_table(design.resampled_ratios(samples, keys), keys), *keys, "stat", "not_finite", "apart")


@query("stock_futures_test", f"""WITH {FRONT}, en AS (SELECT * FROM long_expiries WHERE symbol = '{INDEX}'), dk AS (SELECT expiry AS day, max(CASE WHEN tenor = 'monthly' THEN 2 ELSE 1 END) AS kind FROM en GROUP BY expiry),
    ow AS (SELECT DISTINCT expiry AS day, year(nominal) * 12 + month(nominal) AS ending FROM en WHERE tenor = 'monthly'),
    fl AS (SELECT rr.trade_date, rr.sq, coalesce(kind, 0) AS kind, ow.day IS NOT NULL AS own FROM rr LEFT JOIN dk ON dk.day = rr.trade_date LEFT JOIN ow ON ow.day = rr.trade_date AND ow.ending = rr.expiry_no),
    co AS (SELECT CASE WHEN trade_date < {EVENT} THEN 'any_expiry_pre' ELSE 'any_expiry_post' END AS contrast, CASE WHEN kind > 0 THEN 1 ELSE 0 END AS sample, trade_date, sq FROM fl
      UNION ALL SELECT 'weekly_going_on', CASE WHEN kind = 1 THEN 1 ELSE 0 END, trade_date, sq FROM fl WHERE NOT own AND kind < 2
      UNION ALL SELECT 'monthly_ending_too', CASE WHEN kind = 2 THEN 1 ELSE 0 END, trade_date, sq FROM fl WHERE kind = 2 AND own OR kind = 0 AND NOT own),
    vs AS (SELECT contrast, sample, trade_date AS tie, avg(sq) AS value FROM co GROUP BY contrast, sample, trade_date), {ratio_sql('vs', 'contrast')}""")
def stock_futures_test(v: Views) -> DataFrame:
    """The same for stocks' front contracts, a session one value: any index expiry, weekly ones of contracts that go on, monthly ones of contracts that end too."""
    expiries = v.long_expiries.filter(F.col("symbol") == INDEX)
    samples = design.stock_samples(r.front_returns(v.stock_futures), expiries, F.expr(EVENT))
    return rounded(design.ratio_table(design.resampled_ratios(samples, ["contrast"]), ["contrast"]), "contrast", "stat", "not_finite", "apart")
