"""Domain views over the generic tables, so that every operator has rows at any scale.

Each view is one SELECT that Spark and other SQL engines read alike; names of other views and of tables
stand in it as they are. Nothing here is an operator.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from ..functions.normal import cdf_sql, tail_sql

#: Annual rate of discounting and days of a year.
RATE, YEAR = 0.065, 365.0

#: The weekday, from 0 on Monday, that a symbol's expiries of the long calendar fall on.
EXPIRY_WEEKDAY = """CASE symbol WHEN 'NFT' THEN CASE WHEN {day} < DATE '1998-06-01' THEN 3 ELSE 1 END WHEN 'SNX' THEN CASE WHEN {day} < DATE '1998-06-01' THEN 1 ELSE 3 END
            ELSE CASE WHEN {day} < DATE '1998-06-01' THEN 0 WHEN {day} < DATE '1999-02-15' THEN 2 ELSE 3 END END"""

VIEWS: dict[str, str] = {
    # one row per calendar day with events, numbered from 0
    "sessions": """SELECT day, row_number() OVER (ORDER BY day) - 1 AS session FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d""",
    # event types stand for indices, a day's values in time order for its prices
    "index_daily": """SELECT e.index_name, e.day, s.session, e.o AS open, e.h AS high, e.l AS low, e.c AS close
        FROM (SELECT event_type AS index_name, CAST(ts AS DATE) AS day, max(value) AS h, min(value) AS l,
                     max(CASE WHEN first_no = 1 THEN value END) AS o, max(CASE WHEN last_no = 1 THEN value END) AS c
              FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS first_no,
                           row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS last_no FROM events) x
              GROUP BY event_type, CAST(ts AS DATE)) e JOIN sessions s ON s.day = e.day""",
    # suppliers stand for stocks, the shipping month and the one after it for contracts
    "stock_futures": """SELECT sym, trade_date, expiry_no, avg(price) AS settle, sum(qty) AS vol, count(*) * 100 AS oi
        FROM (SELECT l_suppkey % 20 AS sym, CAST(l_shipdate AS DATE) AS trade_date, year(l_shipdate) * 12 + month(l_shipdate) + l_linenumber % 2 AS expiry_no,
                     l_extendedprice / l_quantity AS price, CAST(l_quantity AS BIGINT) AS qty FROM lineitem) x
        GROUP BY sym, trade_date, expiry_no""",
    # parts stand for (day, symbol, expiry) chains: days from a Monday on, weekly expiries on Thursdays, on Tuesdays for two symbols from week 13
    "chains": """SELECT sy, k, t, off, sym_spot AS spot, eo, es, eo - off AS dte, es - t AS dte_trd, DATE '2024-01-01' + CAST(off AS INT) AS trade_date, DATE '2024-01-01' + CAST(eo AS INT) AS expiry,
               CASE sy WHEN 0 THEN 'AAA' WHEN 1 THEN 'BBB' WHEN 2 THEN 'CCC' ELSE 'DDD' END AS symbol, p_partkey
        FROM (SELECT *, 20000e0 + 1000 * sy + 50 * (t % 40) AS sym_spot, we * 7 + CASE WHEN sy < 2 AND we >= 13 THEN 1 ELSE 3 END AS eo, we * 5 + CASE WHEN sy < 2 AND we >= 13 THEN 1 ELSE 3 END AS es
              FROM (SELECT *, week * 7 + wd AS off, week + k + CASE WHEN wd > 3 OR (wd > 1 AND week >= 13 AND sy < 2) THEN 1 ELSE 0 END AS we
                    FROM (SELECT *, CAST(floor(t / 5e0) AS BIGINT) AS week, t % 5 AS wd
                          FROM (SELECT p_partkey, p_partkey % 4 AS sy, CAST(floor(p_partkey / 4e0) AS BIGINT) % 4 AS k, CAST(floor(p_partkey / 16e0) AS BIGINT) AS t FROM part) a) b) c) d""",
    # eleven strikes and two types on each chain, priced at a planted smile
    "option_panel": """SELECT trade_date, symbol, expiry, t AS session, es AS expiry_session, opt_type, strike, spot, forward, sigma, ttm, dte, dte_trd, discount,
               round(CASE WHEN ttm <= 0 THEN greatest(CASE WHEN opt_type = 'CE' THEN spot - strike ELSE strike - spot END, 0e0)
                          ELSE discount * (CASE WHEN opt_type = 'CE' THEN call ELSE call - forward + strike END) END, 4) AS settle,
               (p_partkey * 7 + j * 13 + ty * 5) % 50 AS volume, (p_partkey * 3 + j) % 40 AS n_trades, 300 + (p_partkey * 11 + j * 17 + ty * 29) % 2000 AS open_int,
               (p_partkey * 11 + j * 17 + ty * 29) % 2000 - ((p_partkey + 1984) * 11 + j * 17 + ty * 29) % 2000 AS chg_oi
        FROM (SELECT *, forward * (CDF_D1) - strike * (CDF_D2) AS call
              FROM (SELECT *, CASE WHEN ttm > 0 THEN (ln(forward / strike) + sigma * sigma * ttm / 2e0) / (sigma * sqrt(ttm)) ELSE 0e0 END AS d1,
                           CASE WHEN ttm > 0 THEN (ln(forward / strike) - sigma * sigma * ttm / 2e0) / (sigma * sqrt(ttm)) ELSE 0e0 END AS d2
                    FROM (SELECT *, 0.12e0 + 0.01e0 * sy + 0.004e0 * k + 0.3e0 * ln(strike / forward) * ln(strike / forward) AS sigma
                          FROM (SELECT *, spot * exp(0.065e0 * dte / 365e0) AS forward, exp(-0.065e0 * dte / 365e0) AS discount, dte / 365e0 AS ttm,
                                       round(spot / 100e0) * 100 + 200 * (j - 5) AS strike
                                FROM chains CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS js(j)
                                CROSS JOIN (VALUES ('CE', 0), ('PE', 1)) AS ts(opt_type, ty)) a) b) c) d""".replace("CDF_D1", cdf_sql("d1")).replace("CDF_D2", cdf_sql("d2")),
    # futures of each chain, carried at another rate than the options' and with a tick of noise
    "index_futures": """SELECT DISTINCT trade_date, symbol, expiry, round(spot * exp(0.06e0 * dte / 365e0) * (1e0 + ((t * 7 + es) % 11 - 5) * 1e-5), 2) AS settle FROM chains WHERE dte >= 1""",
    # the published weekday weights, Monday to Friday, and the spans from an opening day to Tuesday's expiry
    "weights": "SELECT * FROM (VALUES (0, 'Mon', 1.459e0), (1, 'Tue', 0.607e0), (2, 'Wed', 1.093e0), (3, 'Thu', 0.928e0), (4, 'Fri', 0.880e0)) AS w(wd, day, raw)",
    "spans": """SELECT * FROM (VALUES ('Mon', 1), ('Fri', 0), ('Fri', 1), ('Thu', 4), ('Thu', 0), ('Thu', 1), ('Wed', 3), ('Wed', 4), ('Wed', 0), ('Wed', 1),
               ('Tue', 2), ('Tue', 3), ('Tue', 4), ('Tue', 0), ('Tue', 1)) AS s(opened, wd)""",
    # sessions (weekdays from 0, Monday) of each leg of the products that expire on a Tuesday: straddles, and a spread of the next two expiries
    "legs": """SELECT concat('open_', opened) AS product, 1 AS sign, wd FROM spans UNION ALL
        SELECT 'spread_Mon', sign, wd FROM (VALUES (1, 1), (1, 2), (1, 3), (1, 4), (1, 0), (1, 1), (-1, 1)) AS l(sign, wd)""",
    # securities transaction tax periods: start, rate on option sales and on exercised options, percent
    "stt_rates": "SELECT * FROM (VALUES (DATE '2023-04-01', 0.0625e0, 0.125e0), (DATE '2024-10-01', 0.1e0, 0.125e0), (DATE '2026-04-01', 0.15e0, 0.15e0)) AS r(start, sale_pct, exercised_pct)",
    # at-the-money total variance over sessions (t, T] with planted weekday weights and a scale per symbol and date: without noise, so that the fit must give the weights back, and with it
    "atm_obs": """SELECT c.p_partkey AS obs_id, c.symbol, c.trade_date, c.t, c.es, c.k, c.es - c.t AS n_sessions,
               ln((0.5e0 + (c.sy + 1 + c.t % 7) / 40e0) * v.total) AS ln_var, ln((0.5e0 + (c.sy + 1 + c.t % 7) / 40e0) * v.total) + ((c.p_partkey * 7919 + c.es * 31) % 1009 / 1009e0 - 0.5e0) * 0.15e0 AS noisy
        FROM chains c JOIN (SELECT p.t AS t, p.es AS es, p.sy AS sy, sum(w.raw) AS total
                            FROM (SELECT DISTINCT t, es, sy FROM chains) p CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24)) AS ds(d)) ds
                            JOIN weights w ON w.wd = (p.t + 1 + ds.d) % 5 WHERE p.t + 1 + ds.d <= p.es GROUP BY p.t, p.es, p.sy) v
        ON v.t = c.t AND v.es = c.es AND v.sy = c.sy""",
    # a calendar of years: shipping days, of which some weekdays are holidays and some weekend days sessions; what ships on another day counts to the session before
    "ship_sessions": """SELECT ship_day, wd, is_open, greatest(sum(CASE WHEN is_open THEN 1 ELSE 0 END) OVER (ORDER BY ship_day) - 1, 0) AS session,
               max(CASE WHEN is_open THEN ship_day END) OVER (ORDER BY ship_day) AS before
        FROM (SELECT ship_day, wd, row_number() OVER (ORDER BY ship_day) = 1 OR CASE WHEN wd < 5 THEN dayofyear(ship_day) % 61 <> 30 ELSE dayofyear(ship_day) % 50 = 0 END AS is_open
              FROM (SELECT ship_day, CAST(ship_day - DATE '1990-01-01' AS INT) % 7 AS wd FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship_day FROM lineitem) a) b) c""",
    "trading_days": "SELECT ship_day AS day, session, wd FROM ship_sessions WHERE is_open",
    # days that a study leaves out of its weekday means, as budgets and announcements are
    "excluded_days": "SELECT day FROM trading_days WHERE dayofyear(day) % 45 = 7",
    # line numbers stand for two indices, a session's lines in order of their orders for its prices
    "long_daily": """SELECT index_name, d.day, e.session, max(CASE WHEN first_no = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN last_no = 1 THEN price END) AS close
        FROM (SELECT *, row_number() OVER (PARTITION BY index_name, session ORDER BY ship_day, l_orderkey, l_linenumber, price) AS first_no, row_number() OVER (PARTITION BY index_name, session ORDER BY ship_day DESC, l_orderkey DESC, l_linenumber DESC, price DESC) AS last_no
              FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'BNK' ELSE 'NFT' END AS index_name, s.session, s.ship_day, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price
                    FROM lineitem JOIN ship_sessions s ON s.ship_day = CAST(l_shipdate AS DATE)) x) e JOIN trading_days d ON d.session = e.session GROUP BY index_name, d.day, e.session""",
    # expiries of three symbols that change their weekday in June 1998, one of them again in February 1999, and is monthly by then; rolled back to the session before where theirs is none
    "long_expiries": """SELECT symbol, nominal, expiry, tenor
        FROM (SELECT symbol, nominal, expiry, CASE WHEN nominal = max(nominal) OVER (PARTITION BY symbol, year(nominal), month(nominal)) THEN 'monthly' ELSE 'weekly' END AS tenor
              FROM (SELECT symbol, ship_day AS nominal, before AS expiry FROM ship_sessions JOIN (VALUES ('NFT'), ('SNX'), ('BNK')) AS y(symbol) ON wd = EXPIRY_WEEKDAY) x) z
        WHERE symbol <> 'BNK' OR nominal < DATE '1998-06-01' OR tenor = 'monthly'""".replace("EXPIRY_WEEKDAY", EXPIRY_WEEKDAY.format(day="ship_day")),
    # weights of the symbols' sessions: a weekday's, less on the weekday that expiries fall on, and their running sum
    "planted_clock": """SELECT symbol, session, w, sum(w) OVER (PARTITION BY symbol ORDER BY session) AS cum
        FROM (SELECT symbol, session, CASE wd WHEN 0 THEN 1.2e0 WHEN 1 THEN 1e0 WHEN 2 THEN 1.1e0 WHEN 3 THEN 0.95e0 WHEN 4 THEN 0.9e0 ELSE 0.4e0 END * CASE WHEN wd = EXPIRY_WEEKDAY THEN 0.65e0 ELSE 1e0 END AS w
              FROM trading_days CROSS JOIN (VALUES ('NFT'), ('SNX'), ('BNK')) AS y(symbol)) x""".replace("EXPIRY_WEEKDAY", EXPIRY_WEEKDAY.format(day="day")),
    # lines stand for quoted at-the-money variances over sessions (t, es], with noise; suppliers for the symbols
    "term_quotes": """SELECT q.symbol, q.t, q.es, ln((0.5e0 + (q.t % 11) / 20e0) * (b.cum - a.cum)) + noise AS ln_var
        FROM (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'NFT' WHEN 1 THEN 'SNX' ELSE 'BNK' END AS symbol, s.session AS t, least(s.session + 2 + l_partkey % 8, (SELECT max(session) FROM trading_days)) AS es, ((l_orderkey * 7919 + l_linenumber * 10473 + l_partkey * 31) % 1009 / 1009e0 - 0.5e0) * 0.2e0 AS noise
              FROM lineitem JOIN ship_sessions s ON s.ship_day = CAST(l_shipdate AS DATE)) q JOIN planted_clock a ON a.symbol = q.symbol AND a.session = q.t JOIN planted_clock b ON b.symbol = q.symbol AND b.session = q.es WHERE q.es > q.t""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: What a chain's quotes share, and the chains whose quotes one task makes: 22 of each.
CHAIN, CHAINS_A_TASK = ("trade_date", "symbol", "expiry"), 20_000


def _priced_in_steps(panel: str) -> str:
    """The panel's SQL with the same operations in the same order, each tail of the normal a column of a step of its own.

    A step is a generated method, and the JVM compiles none beyond 8,000 bytes: both distributions in one step are left to its interpreter.
    """
    head, steps = panel.split(" AS call\n", 1)
    head = head.replace(f"({cdf_sql('d1')})", "below1").replace(f"({cdf_sql('d2')})", cdf_sql("d2", "tail2"))
    steps = f"FROM (SELECT *, {cdf_sql('d1', 'tail1')} AS below1, {tail_sql('d2')} AS tail2 FROM (SELECT *, {tail_sql('d1')} AS tail1\n{steps.removesuffix(') d')}) f) e) d"
    return f"{head} AS call\n{steps}"


def _needs(text: str, given: Collection[str] = ()) -> list[str]:
    """The views that ``text`` names, those they need first, but those ``given``."""
    out: list[str] = []

    def visit(sql: str) -> None:
        for name, body in VIEWS.items():
            if name not in out and name not in given and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(body)
                if name not in out:
                    out.append(name)

    visit(text)
    return out


def with_views(sql: str, given: Collection[str] = ()) -> str:
    """The query with the views it names in front of it, but those ``given``."""
    sql = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", sql)
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql) if sql.startswith("WITH") else None
    ctes = [f"{name} AS ({VIEWS[name]})" for name in _needs(sql, given)]
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + (",\n" + rest if rest else "\n" + sql)


class Views:
    """Tables and views of one folder as DataFrames: ``views.option_panel``, ``views.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """Runs SQL over the tables and views. Table names are bound to this folder, not to the session's catalogue; views ``given`` as frames stand for their SQL."""
        whole = with_views(text, given)
        bound = {t: self.table(t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", whole)} | given
        escaped = whole.replace("{", "{{").replace("}", "}}")
        for t in bound:
            escaped = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", escaped)
        return self.spark.sql(escaped, **bound)

    @property
    def option_panel(self) -> DataFrame:
        """Quotes over spread chains: parts are small and lie in few row groups, whose tasks would else make, price and group all quotes.
        A task's chains are bounded and whole, so that what groups quotes by their chain moves none of them."""
        return self.sql(_priced_in_steps(VIEWS["option_panel"]), chains=self.spread(self.chains))

    def spread(self, rows: DataFrame) -> DataFrame:
        """Chains, or what was made of them and has lost its place in Python, whole and about ``CHAINS_A_TASK`` a task."""
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-self.part.count() // CHAINS_A_TASK))
        return rows.repartition(tasks, *CHAIN)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


__all__ = ["RATE", "TABLES", "VIEWS", "YEAR", "Views", "with_views"]
