"""Option-surface queries: parity forwards, prices, volatilities, smiles, max pain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import options
from ..functions.normal import cdf_sql, pdf_sql
from ..operators import surface as s
from ..operators.selection import medians
from ..sources.fixtures import Views
from .registry import query

LIVE = "SELECT * FROM option_panel WHERE dte >= 1"
PAIRS = """SELECT trade_date, symbol, expiry, strike, dte, max(CASE WHEN opt_type = 'CE' THEN settle END) AS call, max(CASE WHEN opt_type = 'PE' THEN settle END) AS put
    FROM option_panel WHERE dte >= 1 AND volume > 0 AND n_trades >= 5 AND settle > 0 GROUP BY trade_date, symbol, expiry, strike, dte"""


def forward_ctes(name: str, rate: float) -> str:
    return f"""{name}_f AS (SELECT *, strike + (call - put) / exp(-{rate}e0 * dte / 365e0) AS f FROM ({PAIRS}) p WHERE call IS NOT NULL AND put IS NOT NULL),
    {name}_m AS (SELECT trade_date, symbol, expiry, median(f) AS fwd, count(*) AS n_pairs FROM {name}_f GROUP BY trade_date, symbol, expiry HAVING count(*) >= 6),
    {name} AS (SELECT f.trade_date, f.symbol, f.expiry, f.dte, m.fwd, m.n_pairs, max(abs(f.f - m.fwd)) AS fwd_dev_max, median(abs(f.f - m.fwd)) AS fwd_mad, exp(-{rate}e0 * f.dte / 365e0) AS discount
       FROM {name}_f f JOIN {name}_m m ON f.trade_date = m.trade_date AND f.symbol = m.symbol AND f.expiry = m.expiry GROUP BY f.trade_date, f.symbol, f.expiry, f.dte, m.fwd, m.n_pairs)"""


FWD = forward_ctes("fw", 0.065)
QUOTES = f"""{FWD}, q AS (SELECT p.*, f.fwd, f.discount AS df, p.settle / f.discount AS und, ln(p.strike / f.fwd) AS lm, p.opt_type = 'CE' AS is_call
    FROM ({LIVE}) p JOIN fw f ON p.trade_date = f.trade_date AND p.symbol = f.symbol AND p.expiry = f.expiry
    WHERE p.volume > 0 AND p.n_trades >= 5 AND p.open_int >= 500 AND abs(ln(p.strike / f.fwd)) <= 0.15 AND p.dte_trd >= 2)"""
#: Bisection by recursion, 46 halvings of [1e-4, 5].
_D = "(ln(fwd / strike) / (sg * sqrt(ttm)) + sg * sqrt(ttm) / 2e0)"
SURFACE = f"""{QUOTES},
    qs AS (SELECT *, CASE WHEN is_call THEN und ELSE und + fwd - strike END AS callp FROM q
           WHERE und > greatest(CASE WHEN is_call THEN fwd - strike ELSE strike - fwd END, 0e0) + 1e-8 * fwd AND und < (CASE WHEN is_call THEN fwd ELSE strike END) - 1e-8 * fwd),
    it AS (SELECT trade_date, symbol, expiry, strike, opt_type, fwd, ttm, callp, 1e-4 AS lo, 5e0 AS hi, 0 AS n FROM qs
      UNION ALL
      SELECT trade_date, symbol, expiry, strike, opt_type, fwd, ttm, callp, CASE WHEN v < callp THEN sg ELSE lo END, CASE WHEN v < callp THEN hi ELSE sg END, n + 1 FROM (
        SELECT *, fwd * {cdf_sql('d1')} - strike * {cdf_sql('d2')} AS v FROM (SELECT *, {_D} AS d1, {_D} - sg * sqrt(ttm) AS d2 FROM (SELECT *, (lo + hi) / 2e0 AS sg FROM it WHERE n < 46) a) b) c),
    iv AS (SELECT q.*, (i.lo + i.hi) / 2e0 AS iv FROM q LEFT JOIN (SELECT * FROM it WHERE n = 46 AND lo > 1e-4 AND hi < 5e0) i
           ON q.trade_date = i.trade_date AND q.symbol = i.symbol AND q.expiry = i.expiry AND q.strike = i.strike AND q.opt_type = i.opt_type),
    surf AS (SELECT *, fwd * {pdf_sql('dd')} * sqrt(ttm) * df AS vega FROM (SELECT *, (-lm + iv * iv * ttm / 2e0) / (iv * sqrt(ttm)) AS dd FROM iv) x)"""
_W = "vega * vega"
SMILE = f"""{SURFACE},
    sm AS (SELECT trade_date, symbol, expiry, dte, dte_trd, ttm, count(*) AS n_quotes, sum({_W}) AS s0, sum({_W} * lm) AS s1, sum({_W} * lm * lm) AS s2, sum({_W} * lm * lm * lm) AS s3, sum({_W} * lm * lm * lm * lm) AS s4,
             sum({_W} * iv) AS b0, sum({_W} * lm * iv) AS b1, sum({_W} * lm * lm * iv) AS b2 FROM surf WHERE iv IS NOT NULL AND vega > 0 GROUP BY trade_date, symbol, expiry, dte, dte_trd, ttm HAVING count(*) >= 6),
    dt AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM sm),
    fit AS (SELECT *, (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - b2 * s3) + s2 * (b1 * s3 - b2 * s2)) / det AS a0, (s0 * (b1 * s4 - b2 * s3) - b0 * (s1 * s4 - s2 * s3) + s2 * (s1 * b2 - s2 * b1)) / det AS a1,
             (s0 * (s2 * b2 - s3 * b1) - s1 * (s1 * b2 - s2 * b1) + b0 * (s1 * s3 - s2 * s2)) / det AS a2, (s2 * s4 - s3 * s3) / det AS inv00 FROM dt WHERE det > 0),
    sf AS (SELECT f.trade_date, f.symbol, f.expiry, f.dte, f.dte_trd, f.ttm, f.n_quotes, f.a0 AS atm_iv, sqrt(avg(pow(s.iv - f.a0 - f.a1 * s.lm - f.a2 * s.lm * s.lm, 2))) AS resid_rms,
             sum(s.vega * s.vega * pow(s.iv - f.a0 - f.a1 * s.lm - f.a2 * s.lm * s.lm, 2)) / (f.n_quotes - 3) * f.inv00 AS var_atm_iv
           FROM fit f JOIN surf s ON f.trade_date = s.trade_date AND f.symbol = s.symbol AND f.expiry = s.expiry WHERE s.iv IS NOT NULL AND s.vega > 0
           GROUP BY f.trade_date, f.symbol, f.expiry, f.dte, f.dte_trd, f.ttm, f.n_quotes, f.a0, f.a1, f.a2, f.inv00)"""


def live(v: Views) -> DataFrame:
    return v.option_panel.filter("dte >= 1")


@query("parity_pairs", f"SELECT symbol, count(*) AS n, round(sum(call), 4) AS calls, round(sum(put), 4) AS puts FROM ({PAIRS}) p WHERE call IS NOT NULL AND put IS NOT NULL GROUP BY symbol")
def parity_pairs(v: Views) -> DataFrame:
    return s.pairs(live(v)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("call"), 4).alias("calls"), F.round(F.sum("put"), 4).alias("puts"))


@query("parity_forward", f"WITH {FWD} SELECT trade_date, symbol, expiry, dte, n_pairs, round(fwd, 5) AS forward, round(discount, 9) AS discount, round(fwd_dev_max, 5) AS fwd_dev_max, round(fwd_mad, 5) AS fwd_mad FROM fw")
def parity_forward(v: Views) -> DataFrame:
    return s.forwards(live(v)).select(*s.KEY, "dte", "n_pairs", F.round("fwd", 5).alias("forward"), F.round("discount", 9).alias("discount"), F.round("fwd_dev_max", 5).alias("fwd_dev_max"), F.round("fwd_mad", 5).alias("fwd_mad"))


@query("forward_rate_sensitivity", f"""WITH {forward_ctes('lo', 0.055)}, {forward_ctes('mi', 0.065)}, {forward_ctes('hi', 0.075)} SELECT lo.trade_date, lo.symbol, lo.expiry, round(lo.fwd, 5) AS fwd_0, round(mi.fwd, 5) AS fwd_1, round(hi.fwd, 5) AS fwd_2
    FROM lo JOIN mi ON lo.trade_date = mi.trade_date AND lo.symbol = mi.symbol AND lo.expiry = mi.expiry JOIN hi ON lo.trade_date = hi.trade_date AND lo.symbol = hi.symbol AND lo.expiry = hi.expiry""")
def forward_rate_sensitivity(v: Views) -> DataFrame:
    return s.forward_sensitivity(live(v)).select(*s.KEY, *(F.round(f"fwd_{i}", 5).alias(f"fwd_{i}") for i in range(3)))


@query("forward_vs_futures", f"""WITH {FWD} SELECT f.symbol, count(*) AS n, round(avg((f.fwd / u.settle - 1) * 1e4), 6) AS bias_bp, round(max(abs(f.fwd / u.settle - 1) * 1e4), 6) AS worst_bp FROM fw f JOIN index_futures u ON f.trade_date = u.trade_date AND f.symbol = u.symbol AND f.expiry = u.expiry GROUP BY f.symbol""")
def forward_vs_futures(v: Views) -> DataFrame:
    off = (F.col("fwd") / F.col("settle") - 1) * 1e4
    return s.forwards(live(v)).join(v.index_futures, [*s.KEY]).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(off), 6).alias("bias_bp"), F.round(F.max(F.abs(off)), 6).alias("worst_bp"))


@query("black76_price", f"""SELECT symbol, opt_type, strike, trade_date, expiry, round(CASE WHEN opt_type = 'CE' THEN c ELSE c - forward + strike END, 6) AS price
    FROM (SELECT *, forward * {cdf_sql('d1')} - strike * {cdf_sql('d2')} AS c FROM (SELECT *, ln(forward / strike) / (sigma * sqrt(ttm)) + sigma * sqrt(ttm) / 2e0 AS d1, ln(forward / strike) / (sigma * sqrt(ttm)) - sigma * sqrt(ttm) / 2e0 AS d2 FROM ({LIVE}) p) x) y""")
def black76_price(v: Views) -> DataFrame:
    price = options.black76(F.col("sigma"), F.col("forward"), F.col("strike"), F.col("ttm"), F.col("opt_type") == "CE")
    return live(v).select("symbol", "opt_type", "strike", "trade_date", "expiry", F.round(price, 6).alias("price"))


@query("black76_vega", f"""SELECT symbol, opt_type, strike, trade_date, expiry, round(forward * {pdf_sql('d1')} * sqrt(ttm), 6) AS vega FROM (SELECT *, ln(forward / strike) / (sigma * sqrt(ttm)) + sigma * sqrt(ttm) / 2e0 AS d1 FROM ({LIVE}) p) x""")
def black76_vega(v: Views) -> DataFrame:
    vega = options.vega(F.col("sigma"), F.col("forward"), F.col("strike"), F.col("ttm"))
    return live(v).select("symbol", "opt_type", "strike", "trade_date", "expiry", F.round(vega, 6).alias("vega"))


@query("implied_vol", f"WITH RECURSIVE {SURFACE} SELECT trade_date, symbol, expiry, strike, opt_type, round(iv, 6) AS iv FROM iv")
def implied_vol(v: Views) -> DataFrame:
    return s.surface(v.option_panel).select(*s.KEY, "strike", "opt_type", F.round("iv", 6).alias("iv"))


@query("iv_surface", f"WITH RECURSIVE {SURFACE} SELECT trade_date, symbol, expiry, strike, opt_type, round(fwd, 4) AS fwd, round(lm, 8) AS log_moneyness, round(iv, 6) AS iv, round(vega, 2) AS vega, round(iv * iv * ttm, 8) AS total_var, dte_trd FROM surf")
def iv_surface(v: Views) -> DataFrame:
    return s.surface(v.option_panel).select(*s.KEY, "strike", "opt_type", F.round("fwd", 4).alias("fwd"), F.round("log_moneyness", 8).alias("log_moneyness"), F.round("iv", 6).alias("iv"), F.round("vega", 2).alias("vega"), F.round("total_var", 8).alias("total_var"), "dte_trd")


def smiles(v: Views) -> DataFrame:
    """Smiles of quotes that are spread once more after their volatilities: as many tasks as chains need, however few shuffle partitions there are."""
    return s.smiles(v.spread(s.surface(v.option_panel)))


@query("smile_fit", f"WITH RECURSIVE {SMILE} SELECT trade_date, symbol, expiry, n_quotes, round(atm_iv, 5) AS atm_iv, round(resid_rms, 5) AS resid_rms FROM sf")
def smile_fit(v: Views) -> DataFrame:
    return smiles(v).select(*s.KEY, "n_quotes", F.round("atm_iv", 5).alias("atm_iv"), F.round("resid_rms", 5).alias("resid_rms"))


@query("atm_variance", f"""WITH RECURSIVE {SMILE} SELECT trade_date, symbol, expiry, dte, dte_trd, n_quotes, round(atm_iv, 5) AS atm_iv, round(atm_iv * atm_iv * ttm, 7) AS total_var_raw,
    round(CASE WHEN atm_iv * atm_iv - var_atm_iv > 0 THEN (atm_iv * atm_iv - var_atm_iv) * ttm END, 7) AS total_var_corr, round(var_atm_iv / (atm_iv * atm_iv), 5) AS noise_share FROM sf""")
def atm_variance(v: Views) -> DataFrame:
    found = s.atm_variance(smiles(v))
    return found.select(*s.KEY, "dte", "dte_trd", "n_quotes", F.round("atm_iv", 5).alias("atm_iv"), F.round("total_var_raw", 7).alias("total_var_raw"), F.round("total_var_corr", 7).alias("total_var_corr"), F.round("noise_share", 5).alias("noise_share"))


@query("dte_bucket_summary", f"""WITH RECURSIVE {SMILE} SELECT CASE WHEN dte <= 3 THEN '1-3' WHEN dte <= 7 THEN '4-7' WHEN dte <= 14 THEN '8-14' WHEN dte <= 30 THEN '15-30' ELSE '31+' END AS bucket, count(*) AS n, round(median(atm_iv), 5) AS median_iv, round(median(n_quotes), 3) AS median_quotes FROM sf GROUP BY 1""")
def dte_bucket_summary(v: Views) -> DataFrame:
    """Smiles by days to expiry; the medians of few buckets are selected exactly by histograms, so no task holds a bucket."""
    found = smiles(v).withColumn("bucket", s.dte_bucket(F.col("dte")))
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value")) for c in ("atm_iv", "n_quotes"))))
    middle = medians(found.select("bucket", both.alias("b")).select("bucket", "b.*"), ["bucket", "what"], "value")
    of = lambda c: F.max(F.when(F.col("what") == c, F.col("median")))
    return middle.groupBy("bucket").agg(F.max("n").alias("n"), F.round(of("atm_iv"), 5).alias("median_iv"), F.round(of("n_quotes"), 3).alias("median_quotes"))


PAIN = """pain AS (SELECT s.trade_date, s.symbol, s.expiry, s.strike, max(s.n) AS n, sum(CASE WHEN o.opt_type = 'CE' THEN o.open_int * greatest(s.strike - o.strike, 0) ELSE o.open_int * greatest(o.strike - s.strike, 0) END) AS pain
      FROM (SELECT trade_date, symbol, expiry, strike, sum(count(*)) OVER (PARTITION BY trade_date, symbol, expiry) AS n FROM option_panel GROUP BY trade_date, symbol, expiry, strike) s
      JOIN option_panel o ON o.trade_date = s.trade_date AND o.symbol = s.symbol AND o.expiry = s.expiry GROUP BY s.trade_date, s.symbol, s.expiry, s.strike),
    mp AS (SELECT trade_date, symbol, expiry, strike AS max_pain, pain FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, symbol, expiry ORDER BY pain, strike) AS best FROM pain WHERE n >= 20) x WHERE best = 1)"""


@query("max_pain", f"WITH {PAIN} SELECT trade_date, symbol, expiry, max_pain, round(pain, 3) AS pain FROM mp")
def max_pain(v: Views) -> DataFrame:
    return s.max_pain(v.option_panel).withColumn("pain", F.round("pain", 3))


@query("max_pain_convergence", f"""WITH {PAIN} SELECT CASE WHEN c.dte <= 3 THEN '1-3' WHEN c.dte <= 7 THEN '4-7' WHEN c.dte <= 14 THEN '8-14' WHEN c.dte <= 30 THEN '15-30' ELSE '31+' END AS bucket, count(*) AS n,
    round(median(abs(m.max_pain / c.spot - 1)), 8) AS median_distance FROM mp m JOIN chains c ON c.trade_date = m.trade_date AND c.symbol = m.symbol AND c.expiry = m.expiry GROUP BY 1""")
def max_pain_convergence(v: Views) -> DataFrame:
    spot = v.chains.select(*s.KEY, "spot", "dte")
    joined = s.max_pain(v.option_panel).join(spot, [*s.KEY]).withColumn("bucket", s.dte_bucket(F.col("dte")))
    middle = medians(joined.withColumn("distance", F.abs(F.col("max_pain") / F.col("spot") - 1)), ["bucket"], "distance")
    return middle.select("bucket", "n", F.round("median", 8).alias("median_distance"))


@query("max_pain_gap_at_expiry", f"""WITH {PAIN}, sp AS (SELECT DISTINCT symbol, trade_date AS day, spot FROM chains),
    gp AS (SELECT date_diff('day', m.trade_date, m.expiry) AS dte, abs(a.spot - m.max_pain) / a.spot * 100 AS gap_now, abs(b.spot - m.max_pain) / b.spot * 100 AS gap_final
      FROM mp m JOIN sp a ON a.symbol = m.symbol AND a.day = m.trade_date JOIN sp b ON b.symbol = m.symbol AND b.day = m.expiry)
    SELECT CASE WHEN dte <= 3 THEN '1-3' WHEN dte <= 7 THEN '4-7' WHEN dte <= 14 THEN '8-14' ELSE '15-35' END AS bucket, count(*) AS n, round(avg(gap_now), 6) AS gap_now, round(avg(gap_final), 6) AS gap_final
    FROM gp WHERE dte BETWEEN 1 AND 35 GROUP BY 1""")
def max_pain_gap_at_expiry(v: Views) -> DataFrame:
    """Mean distances of spot from max pain, on the quote day and at expiry, in the reference's buckets: the second beside the first shows convergence or not."""
    spots = v.chains.select("symbol", F.col("trade_date").alias("day"), "spot").distinct()
    gaps = s.max_pain_gaps(s.max_pain(v.option_panel), spots).filter("dte between 1 and 35")
    bucket = F.when(F.col("dte") <= 14, s.dte_bucket(F.col("dte"))).otherwise("15-35")
    return gaps.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("gap_now"), 6).alias("gap_now"), F.round(F.avg("gap_final"), 6).alias("gap_final"))
