"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every text starts with the fact mapping CTE and the anchors CTE, and aliases
every output column to the name the Spark query uses. Orders that pick a
top-k spell out NULLS FIRST/LAST to match Spark's defaults.
"""

from __future__ import annotations

from adpulse.config import TEST_CONFIG as CFG
from adpulse.functions.labels import WHITE_SPACE
from adpulse.plans.registry import AD_GROUP, BRAND, CAMPAIGN, DETAIL_BRAND, TEST_TARGETS
from adpulse.sources.tpch_fact import FACT_CTE

M = CFG.missing


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(c: str) -> str:
    return f"trim({c}, {_q(WHITE_SPACE)})"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


ANCHORS_CTE = """,
dates AS (SELECT DISTINCT activity_date AS d FROM ad_fact WHERE activity_date IS NOT NULL),
anch AS (
  SELECT max(d) AS d_max,
         coalesce(max(d) FILTER (WHERE d < (SELECT max(d) FROM dates)), max(d)) AS d_prev,
         min(d) AS d_min,
         CAST(date_trunc('month', max(d)) AS DATE) AS month_start
  FROM dates
)"""

HEAD = FACT_CTE + ANCHORS_CTE


def roas_sql(rev: str, cost: str, scale: str = " * 100.0") -> str:
    return (f"CASE WHEN CAST({cost} AS DOUBLE) <> 0 "
            f"THEN CAST({rev} AS DOUBLE) / CAST({cost} AS DOUBLE){scale} ELSE 0.0 END")


def valid_sql(c: str, with_missing: bool = False) -> str:
    bad = ["", "-"] + ([M] if with_missing else [])
    return f"({c} IS NOT NULL AND {strip_sql(f"CAST({c} AS VARCHAR)")} NOT IN {_in(bad)})"


def trunc_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '…' ELSE {c} END"


STORE = f"coalesce({strip_sql("channel")} = {_q(CFG.store_channel)}, false)"
MARKET = f"coalesce(contains(channel, {_q(CFG.market_marker)}), false)"
PRODUCT_ROWS = (f"{STORE} AND {valid_sql('product')} AND NOT regexp_matches("
                f"coalesce(media, ''), {_q(CFG.product_excluded_media)})")
MTD = "activity_date BETWEEN a.month_start AND a.d_max"
ALLH = "activity_date BETWEEN a.d_min AND a.d_max"

CMP_COLS = ("rev_cur, rev_prev, rev_delta, cost_cur, cost_prev, cost_delta, buy_cur, buy_prev, "
            "buy_delta, roas_cur, roas_prev, roas_delta, influence")


def cmp_sql(keys: list[str], basis: str, where: str = "TRUE", fill: bool = True,
            src: str = "ad_fact") -> str:
    """Two-day comparison as a sub-select (keys + CMP_COLS)."""
    rev, buy = {"ss": ("rev_ss", "buy_ss"), "db": ("rev_db", "buy_db")}[basis]
    kx = ", ".join(f"coalesce(CAST({k} AS VARCHAR), {_q(M)}) AS {k}" if fill else k
                   for k in keys)
    ks = ", ".join(keys)
    return f"""(
  SELECT {ks},
    CAST(rc AS DOUBLE) AS rev_cur, CAST(rp AS DOUBLE) AS rev_prev,
    CAST(rc - rp AS DOUBLE) AS rev_delta,
    CAST(cc AS DOUBLE) AS cost_cur, CAST(cp AS DOUBLE) AS cost_prev,
    CAST(cc - cp AS DOUBLE) AS cost_delta,
    CAST(bc AS BIGINT) AS buy_cur, CAST(bp AS BIGINT) AS buy_prev,
    CAST(bc - bp AS BIGINT) AS buy_delta,
    {roas_sql('rc', 'cc')} AS roas_cur, {roas_sql('rp', 'cp')} AS roas_prev,
    {roas_sql('rc', 'cc')} - {roas_sql('rp', 'cp')} AS roas_delta,
    abs(CAST(rc - rp AS DOUBLE)) AS influence
  FROM (
    SELECT {ks},
      coalesce(sum(CASE WHEN activity_date = a.d_max THEN rev END), 0) AS rc,
      coalesce(sum(CASE WHEN activity_date = a.d_prev THEN rev END), 0) AS rp,
      coalesce(sum(CASE WHEN activity_date = a.d_max THEN cost END), 0) AS cc,
      coalesce(sum(CASE WHEN activity_date = a.d_prev THEN cost END), 0) AS cp,
      coalesce(sum(CASE WHEN activity_date = a.d_max THEN buy END), 0) AS bc,
      coalesce(sum(CASE WHEN activity_date = a.d_prev THEN buy END), 0) AS bp
    FROM (SELECT {kx}, activity_date, {rev} AS rev, cost, {buy} AS buy
          FROM {src}, anch a
          WHERE activity_date IN (a.d_max, a.d_prev) AND ({where})) x, anch a
    GROUP BY {ks}
  ) s
)"""


def infl(keys: list[str]) -> str:
    return "influence DESC NULLS LAST, " + ", ".join(f"{k} ASC NULLS FIRST" for k in keys)


def dir2(c: str) -> str:
    return f"CASE WHEN {c} >= 0 THEN 'up' ELSE 'down' END"


def dir3(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN 'up' WHEN {c} < 0 THEN 'down' ELSE 'flat' END"


SUM7 = ", ".join(f"coalesce(sum({m}), 0) AS {m}" for m in
                 ("impressions", "clicks", "cost", "buy_ss", "rev_ss", "buy_db", "rev_db"))


def record_cols(p: str = "") -> str:
    """The typed 11-key record from summed columns (optionally prefixed)."""
    def c(x):
        return f"{p}{x}"
    return f"""CAST({c('impressions')} AS BIGINT) AS impressions,
    CAST({c('clicks')} AS BIGINT) AS clicks,
    {roas_sql(c('cost'), c('clicks'), '')} AS cpc,
    {roas_sql(c('clicks'), c('impressions'))} AS ctr,
    CAST({c('cost')} AS DOUBLE) AS cost,
    CAST({c('buy_ss')} AS BIGINT) AS buy_ss,
    CAST({c('rev_ss')} AS DOUBLE) AS rev_ss,
    {roas_sql(c('rev_ss'), c('cost'))} AS roas_ss,
    CAST({c('buy_db')} AS BIGINT) AS buy_db,
    CAST({c('rev_db')} AS DOUBLE) AS rev_db,
    {roas_sql(c('rev_db'), c('cost'))} AS roas_db"""


def totals_sql(start: str, end: str, extra: str = "TRUE") -> str:
    return HEAD + f"""
SELECT {start} AS period_start, {end} AS period_end, {record_cols()}
FROM (SELECT {SUM7} FROM ad_fact, anch a
      WHERE activity_date BETWEEN {start} AND {end} AND ({extra})) t, anch a"""


def periods_cte(rows: str) -> str:
    """Period table p(period, period_idx, s, e) + its records r."""
    return f""",
p AS ({rows}),
r AS (
  SELECT p.period, p.period_idx, p.s AS period_start, p.e AS period_end, {record_cols('t.')}
  FROM p LEFT JOIN (
    SELECT p.period_idx, {SUM7.replace('sum(', 'sum(f.')}
    FROM p JOIN ad_fact f ON f.activity_date BETWEEN p.s AND p.e
    GROUP BY p.period_idx) t ON t.period_idx = p.period_idx
)"""


def _zero_record_fix(sql: str) -> str:
    # Periods without rows: the LEFT JOIN gives NULL sums; make them 0.
    for m in ("impressions", "clicks", "cost", "buy_ss", "rev_ss", "buy_db", "rev_db"):
        sql = sql.replace(f"t.{m}", f"coalesce(t.{m}, 0)")
    return sql


def standard_periods_sql(s: str, e: str, n: str) -> str:
    return f"""
  SELECT 'selection' AS period, 0 AS period_idx, {s} AS s, {e} AS e FROM anch a UNION ALL
  SELECT 'prev_period', 1, {s} - 1 - ({n} - 1), {s} - 1 FROM anch a UNION ALL
  SELECT 'same_weekday', 2, {s} - 7, {e} - 7 FROM anch a UNION ALL
  SELECT 'two_days_before', 3, {s} - 2 - ({n} - 1), {s} - 2 FROM anch a UNION ALL
  SELECT 'three_days_before', 4, {s} - 3 - ({n} - 1), {s} - 3 FROM anch a"""


def multi_period_sql(s: str, e: str, n: str) -> str:
    return HEAD + _zero_record_fix(periods_cte(standard_periods_sql(s, e, n))) + """
SELECT * FROM r"""


BASIS_METRICS = {
    "ss": (("cost", "cost"), ("purchases", "buy_ss"), ("revenue", "rev_ss"), ("roas", "roas_ss")),
    "db": (("cost", "cost"), ("purchases", "buy_db"), ("revenue", "rev_db"), ("roas", "roas_db")),
}
LABELS = ("prev_period", "same_weekday", "two_days_before", "three_days_before")
RECORD = ("impressions", "clicks", "cpc", "ctr", "cost",
          "buy_ss", "rev_ss", "roas_ss", "buy_db", "rev_db", "roas_db")


def pick(col: str, idx: int) -> str:
    return f"max(CASE WHEN period_idx = {idx} THEN CAST({col} AS DOUBLE) END)"


def multi_period_delta_sql(basis: str) -> str:
    parts = []
    for k, (name, src) in enumerate(BASIS_METRICS[basis]):
        deltas = ", ".join(f"{pick(src, 0)} - {pick(src, i + 1)} AS delta_{lbl}"
                           for i, lbl in enumerate(LABELS))
        parts.append(f"SELECT {_q(basis.upper())} AS basis, {k} AS metric_idx, {_q(name)} AS metric, "
                     f"{pick(src, 0)} AS value, {deltas} FROM r")
    return (HEAD + _zero_record_fix(periods_cte(standard_periods_sql("a.d_max", "a.d_max", "1")))
            + "\n" + "\nUNION ALL\n".join(parts))


def period_delta_core() -> str:
    rows = """
  SELECT 'base' AS period, 0 AS period_idx, a.d_max AS s, a.d_max AS e FROM anch a UNION ALL
  SELECT 'comp', 1, a.d_max - 1, a.d_max - 1 FROM anch a"""
    parts = []
    for k, m in enumerate(RECORD):
        parts.append(f"SELECT {k} AS metric_idx, {_q(m)} AS metric, {pick(m, 0)} AS base_value, "
                     f"{pick(m, 1)} AS comp_value, {pick(m, 0)} - {pick(m, 1)} AS delta FROM r")
    return (HEAD + _zero_record_fix(periods_cte(rows)) + ",\npd AS (\n"
            + "\nUNION ALL\n".join(parts) + "\n)")


HEADLINE = ("buy_ss", "buy_db", "rev_ss", "rev_db", "roas_ss", "roas_db")


def daily_headline_sql() -> str:
    rows = """
  SELECT 'cur' AS period, 0 AS period_idx, a.d_max AS s, a.d_max AS e FROM anch a UNION ALL
  SELECT 'prev', 1, a.d_prev, a.d_prev FROM anch a UNION ALL
  SELECT 'same_weekday', 2, a.d_max - 7, a.d_max - 7 FROM anch a"""
    parts = []
    for k, m in enumerate(HEADLINE):
        parts.append(f"SELECT {k} AS metric_idx, {_q(m)} AS metric, {pick(m, 0)} AS value, "
                     f"{pick(m, 0)} - {pick(m, 1)} AS delta_prev, "
                     f"{pick(m, 0)} - {pick(m, 2)} AS delta_same_weekday FROM r")
    return (HEAD + _zero_record_fix(periods_cte(rows)) + ",\nh AS (\n" + "\nUNION ALL\n".join(parts)
            + "\n)\nSELECT a.d_max AS day, a.d_prev AS prev_day, a.d_max - 7 AS same_weekday_day, "
            "h.*, " + dir2("h.delta_prev") + " AS direction FROM h, anch a")


def topk_sql(inner: str, part: str, order: str, k: int, rank: str = "rank") -> str:
    over = f"PARTITION BY {part} " if part else ""
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER ({over}ORDER BY {order}) AS {rank} FROM {inner} z
) q WHERE {rank} <= {k}"""


def grouped(keys: str, cols: list[str], where: str) -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in cols)
    return f"(SELECT {keys}, {sums} FROM ad_fact, anch a WHERE {where} GROUP BY {keys})"


def typed(cols: list[str]) -> str:
    out = []
    for c in cols:
        t = "BIGINT" if c.startswith(("impressions", "clicks", "buy")) else "DOUBLE"
        out.append(f"CAST({c} AS {t}) AS {c}")
    return ", ".join(out)


ALL7 = ["impressions", "clicks", "cost", "rev_ss", "buy_ss", "rev_db", "buy_db"]


def campaign_top_sql(period: str) -> str:
    g = grouped("media, campaign, ad_group", ALL7, f"{period} AND media IS NOT NULL")
    inner = (f"(SELECT media, campaign, ad_group, {typed(ALL7)}, "
             f"{roas_sql('rev_ss', 'cost')} AS roas_ss, {roas_sql('rev_db', 'cost')} AS roas_db "
             f"FROM {g} g)")
    return HEAD + "\n" + topk_sql(inner, "media", "rev_ss DESC NULLS LAST, campaign ASC NULLS FIRST, "
                                  "ad_group ASC NULLS FIRST", 30)


def keyword_top_sql(period: str) -> str:
    cols = ["rev_ss", "buy_ss", "cost"]
    g = grouped("media, keyword", cols,
                f"{period} AND media IN {_in(CFG.keyword_media)} AND {valid_sql('keyword')}")
    inner = f"(SELECT media, keyword, {typed(cols)}, {roas_sql('rev_ss', 'cost')} AS roas_ss FROM {g} g)"
    return HEAD + "\n" + topk_sql(inner, "media", "rev_ss DESC NULLS LAST, keyword ASC NULLS FIRST", 20)


def creative_top_sql(period: str) -> str:
    cols = ["rev_ss", "buy_ss", "cost", "rev_db", "buy_db"]
    g = grouped("media, creative", cols,
                f"{period} AND media IN {_in(CFG.creative_media)} AND {valid_sql('creative')}")
    inner = (f"(SELECT media, creative, {typed(cols)}, {roas_sql('rev_ss', 'cost')} AS roas_ss, "
             f"{roas_sql('rev_db', 'cost')} AS roas_db FROM {g} g)")
    return HEAD + "\n" + topk_sql(inner, "media", "rev_db DESC NULLS LAST, creative ASC NULLS FIRST", 20)


def top_products_sql(period: str) -> str:
    g = grouped("product", ["rev_ss", "buy_ss"], f"{period} AND {PRODUCT_ROWS}")
    inner = f"(SELECT product, {typed(['rev_ss', 'buy_ss'])} FROM {g} g)"
    return HEAD + f"""
SELECT rank, product, {trunc_sql('product', CFG.label_len_short)} AS short_label, rev_ss, buy_ss
FROM ({topk_sql(inner, '', 'rev_ss DESC NULLS LAST, product ASC NULLS FIRST', 10)}) t"""


def media_top_products_sql(period: str) -> str:
    g = grouped("media, product", ["rev_ss", "buy_ss"],
                f"{period} AND {PRODUCT_ROWS} AND media IS NOT NULL")
    inner = f"(SELECT media, product, {typed(['rev_ss', 'buy_ss'])} FROM {g} g)"
    return HEAD + "\n" + topk_sql(inner, "media", "rev_ss DESC NULLS LAST, product ASC NULLS FIRST", 10)


def cmp_query(keys: list[str], basis: str, where: str = "TRUE") -> str:
    return HEAD + f"\nSELECT * FROM {cmp_sql(keys, basis, where)} c"


SECTIONED = f"""(
  SELECT 'store' AS section, * FROM ad_fact WHERE {STORE}
  UNION ALL
  SELECT 'market' AS section, * FROM ad_fact WHERE {MARKET}
)"""


def channel_drivers_cte(k: int = 3) -> str:
    cmp = cmp_sql(["section", "media"], "ss", src=SECTIONED)
    return f""",
cd AS (
  {topk_sql(cmp, 'section', infl(['media']), k)}
)"""


PRODUCT_DRIVERS_CTE = f""",
pd AS (
  SELECT * FROM (
    SELECT par.section, par.media_rank, c.*,
           row_number() OVER (PARTITION BY par.section, c.media ORDER BY {infl(['product'])}) AS rank
    FROM {cmp_sql(['media', 'product'], 'ss', valid_sql('product', True))} c
    JOIN (SELECT section, rank AS media_rank, media FROM cd
          WHERE NOT contains(media, {_q(CFG.market_marker)})) par ON par.media = c.media
  ) q WHERE rank <= 3
)"""


def path_sql(fallback: str) -> str:
    parts = ", ".join(f"CASE WHEN {c} IS NULL OR {c} IN {_in(['', M, 'nan'])} THEN NULL ELSE {c} END"
                      for c in ("campaign", "ad_group"))
    return f"CASE WHEN concat_ws(' > ', {parts}) = '' THEN {_q(fallback)} ELSE concat_ws(' > ', {parts}) END"


def campaign_drivers_cte(k: int) -> str:
    cmp = cmp_sql(["media", "campaign", "ad_group"], "db")
    return f""",
mc AS (
  SELECT *, {path_sql(CFG.path_fallback_driver)} AS label, {dir2('rev_delta')} AS direction
  FROM ({topk_sql(cmp, 'media', infl(['campaign', 'ad_group']), k)}) t
)"""


DISPLAY_CTE = f""",
dm AS (
  SELECT *, row_number() OVER (ORDER BY {infl(['media'])}) AS rank
  FROM {cmp_sql(['media'], 'db', 'media IN ' + _in(CFG.display_sub_media))} c
)"""

TREE_COLS = "rev_cur, rev_delta, cost_cur, cost_delta, buy_delta, roas_cur, roas_delta"


def kpi_sql() -> str:
    vals = ",\n    ".join(
        f"({i}, {_q(ch)}, {float(c)}, {float(r)}, {float(o)})"
        for i, (ch, c, r, o) in enumerate(TEST_TARGETS, start=1))
    key = f"lower({strip_sql('channel')})"
    store = " OR ".join([f"{key} = {_q(CFG.store_channel.lower())}"]
                        + [f"contains({key}, {_q(x.lower())})" for x in CFG.store_target_aliases])
    market = " OR ".join([f"{key} IN {_in([n.lower() for n in CFG.market_target_names])}"]
                         + [f"contains({key}, {_q(x.lower())})" for x in CFG.market_target_aliases])
    ch = "lower(coalesce(channel, ''))"
    is_s = f"contains({ch}, {_q(CFG.store_marker.lower())})"
    is_m = f"contains({ch}, {_q(CFG.market_marker.lower())})"
    return HEAD + f""",
traw(idx, channel, target_cost, target_rev, target_roas) AS (VALUES
    {vals}),
tdedup AS (
  SELECT {strip_sql('channel')} AS channel, min(idx) AS idx, max_by(target_cost, idx) AS target_cost,
         max_by(target_rev, idx) AS target_rev, max_by(target_roas, idx) AS target_roas
  FROM traw GROUP BY 1),
t AS (
  SELECT CAST(row_number() OVER (ORDER BY idx) AS BIGINT) AS target_idx, channel,
         CAST(target_cost AS DOUBLE) AS target_cost, CAST(target_rev AS DOUBLE) AS target_rev,
         CAST(target_roas AS DOUBLE) AS target_roas
  FROM tdedup),
tr AS (
  SELECT *, CASE WHEN {store} THEN 'store' WHEN {market} THEN 'market'
                 WHEN {key} = {_q(CFG.other_target.lower())} THEN 'other' ELSE 'none' END AS rule
  FROM t),
rv AS (
  SELECT coalesce(sum(CASE WHEN {is_s} THEN rev_ss END), 0) AS store,
         coalesce(sum(CASE WHEN {is_m} THEN rev_ss END), 0) AS market,
         coalesce(sum(CASE WHEN NOT {is_s} AND NOT {is_m} THEN rev_ss END), 0) AS other
  FROM ad_fact, anch a WHERE {MTD}),
rr AS (
  SELECT 'store' AS rule, store AS achieved FROM rv UNION ALL
  SELECT 'market', market FROM rv UNION ALL
  SELECT 'other', other FROM rv),
j AS (
  SELECT tr.target_idx, tr.channel, tr.rule, CAST(coalesce(rr.achieved, 0) AS DOUBLE) AS achieved,
         tr.target_rev, tr.target_cost, tr.target_roas
  FROM tr LEFT JOIN rr ON rr.rule = tr.rule),
k AS (
  SELECT *,
    CASE WHEN target_rev <> 0 THEN least(achieved / target_rev, 1.0) * 100.0 ELSE 0.0 END AS rate_pct,
    (CASE WHEN target_rev <> 0 THEN achieved / target_rev ELSE 0.0 END) * 100.0 AS rate_pct_uncapped
  FROM j)
SELECT *, CASE WHEN rate_pct >= {CFG.band_green} THEN 'green'
               WHEN rate_pct >= {CFG.band_amber} THEN 'amber' ELSE 'red' END AS band
FROM k"""


def media_daily_sql() -> str:
    return HEAD + """,
g AS (SELECT media, strftime(activity_date, '%Y-%m-%d') AS day, sum(rev_db) AS v
      FROM ad_fact WHERE activity_date IS NOT NULL GROUP BY media, day),
ms AS (SELECT DISTINCT media FROM g),
ds AS (SELECT DISTINCT day FROM g)
SELECT ms.media, ds.day, coalesce(CAST(g.v AS DOUBLE), 0.0) AS rev_db
FROM ms CROSS JOIN ds
LEFT JOIN g ON g.media IS NOT DISTINCT FROM ms.media AND g.day = ds.day"""


def promo_sql() -> str:
    t = f"coalesce({strip_sql('CAST(promo AS VARCHAR)')}, '')"
    cls = (f"CASE WHEN contains({t}, {_q(CFG.always_on_marker)}) THEN 'always_on' "
           f"WHEN {t} <> '' THEN 'promotion' ELSE 'unclassified' END")
    return HEAD + f""",
g AS (
  SELECT media, promo_class,
    coalesce(sum(CASE WHEN activity_date = a.d_max THEN cost END), 0) AS c1,
    coalesce(sum(CASE WHEN activity_date = a.d_max THEN rev_db END), 0) AS r1,
    coalesce(sum(CASE WHEN activity_date = a.d_prev THEN cost END), 0) AS c0,
    coalesce(sum(CASE WHEN activity_date = a.d_prev THEN rev_db END), 0) AS r0
  FROM (SELECT media, {cls} AS promo_class, activity_date, cost, rev_db
        FROM ad_fact WHERE media IS NOT NULL) x, anch a
  WHERE promo_class <> 'unclassified'
  GROUP BY media, promo_class)
SELECT media, promo_class,
  CAST(r1 AS DOUBLE) AS rev_cur, CAST(r0 AS DOUBLE) AS rev_prev, CAST(r1 - r0 AS DOUBLE) AS rev_delta,
  CAST(c1 AS DOUBLE) AS cost_cur, CAST(c0 AS DOUBLE) AS cost_prev, CAST(c1 - c0 AS DOUBLE) AS cost_delta,
  {roas_sql('r1', 'c1')} AS roas_cur, {roas_sql('r0', 'c0')} AS roas_prev,
  {roas_sql('r1', 'c1')} - {roas_sql('r0', 'c0')} AS roas_delta
FROM g"""


def roas_trend_sql() -> str:
    r = f"round_even({roas_sql('rev_ss', 'cost')}, 1)"
    return HEAD + f""",
days AS (SELECT d FROM dates, anch a WHERE d <= a.d_max ORDER BY d DESC LIMIT 7),
daily AS (
  SELECT activity_date, coalesce(sum(rev_ss), 0) AS rev_ss, coalesce(sum(cost), 0) AS cost
  FROM ad_fact WHERE activity_date IN (SELECT d FROM days) GROUP BY activity_date),
t AS (
  SELECT activity_date, strftime(activity_date, '%m/%d') AS label, {r} AS roas_ss,
         round_even(CAST(cost AS DOUBLE) / 10000.0, 1) AS cost_10k
  FROM daily)
SELECT activity_date, label, roas_ss, cost_10k,
  CAST(sum(CAST(roas_ss AS DECIMAL(20,1))) OVER () AS DOUBLE) / CAST(count(*) OVER () AS DOUBLE)
    AS avg_roas_ss
FROM t"""


PRODUCT_TOP10_CTE = f""",
pg AS (
  SELECT media, product,
    bool_or(activity_date = a.d_max) AS on_last,
    coalesce(sum(CASE WHEN activity_date = a.d_max THEN rev_db END), 0) AS rv1,
    coalesce(sum(CASE WHEN activity_date = a.d_max THEN cost END), 0) AS c1,
    coalesce(sum(CASE WHEN activity_date = a.d_max THEN buy_db END), 0) AS b1,
    coalesce(sum(CASE WHEN activity_date = a.d_prev THEN rev_db END), 0) AS rv0,
    coalesce(sum(CASE WHEN activity_date = a.d_prev THEN cost END), 0) AS c0,
    coalesce(sum(CASE WHEN activity_date = a.d_prev THEN buy_db END), 0) AS b0
  FROM (SELECT media, coalesce(CAST(product AS VARCHAR), {_q(M)}) AS product, activity_date,
               rev_db, cost, buy_db
        FROM ad_fact, anch a
        WHERE activity_date IN (a.d_max, a.d_prev) AND media IS NOT NULL) x, anch a
  GROUP BY media, product),
pt AS (
  SELECT media, rank, product,
    CAST(b1 AS BIGINT) AS buy_cur, CAST(b0 AS BIGINT) AS buy_prev, CAST(b1 - b0 AS BIGINT) AS buy_delta,
    CAST(rv1 AS DOUBLE) AS rev_cur, CAST(rv0 AS DOUBLE) AS rev_prev, CAST(rv1 - rv0 AS DOUBLE) AS rev_delta,
    round_even({roas_sql('rv1', 'c1')}, 1) AS roas_cur,
    round_even({roas_sql('rv0', 'c0')}, 1) AS roas_prev,
    CASE WHEN c1 <> 0 AND c0 <> 0 THEN round_even((CAST(rv1 AS DOUBLE) / CAST(c1 AS DOUBLE)
         - CAST(rv0 AS DOUBLE) / CAST(c0 AS DOUBLE)) * 100.0, 1) ELSE 0.0 END AS roas_delta
  FROM ({topk_sql('(SELECT * FROM pg WHERE on_last)', 'media',
                  'rv1 DESC NULLS LAST, product ASC NULLS FIRST', 10)}) q)"""


def product_movers_sql(per_media: bool, gainers: bool) -> str:
    keys = ["media", "product"] if per_media else ["product"]
    where = PRODUCT_ROWS + (" AND media IS NOT NULL" if per_media else "")
    cmp = (f"(SELECT * FROM {cmp_sql(keys, 'ss', where)} c "
           f"WHERE product <> {_q(M)} AND {strip_sql('product')} <> '-' "
           f"AND rev_delta {'>' if gainers else '<'} 0)")
    order = infl(["product"]) if gainers else "rev_delta ASC NULLS FIRST, product ASC NULLS FIRST"
    return HEAD + "\n" + topk_sql(cmp, "media" if per_media else "", order, 10)


def per_media_change_sql(keys: list[str], basis: str, where: str) -> str:
    cmp = cmp_sql(["media"] + keys, basis, f"media IS NOT NULL AND {where}")
    return HEAD + "\n" + topk_sql(cmp, "media", infl(keys), 20)


def fmt_money(c: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST({c} AS DOUBLE), 0) AS BIGINT))"


def fmt_signed_money(c: str) -> str:
    w = f"CAST(round_even(CAST({c} AS DOUBLE), 0) AS BIGINT)"
    return f"(CASE WHEN {w} < 0 THEN '-' ELSE '+' END || format('{{:,}}', abs({w})))"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["compare_media_ss"] = cmp_query(["media"], "ss")
    q["compare_campaign_db"] = cmp_query(["campaign", "ad_group"], "db")
    q["day_anchors"] = HEAD + "\nSELECT d_max, d_prev, d_min, month_start FROM anch"
    q["scan_snapshot"] = FACT_CTE + """
SELECT activity_date, channel, media, campaign, ad_group, creative, keyword, brand, product, promo,
       impressions, clicks, CAST(cost AS DOUBLE) AS cost, CAST(rev_ss AS DOUBLE) AS rev_ss,
       CAST(rev_db AS DOUBLE) AS rev_db, buy_ss, buy_db,
       CAST(rev_market_a AS DOUBLE) AS rev_market_a, CAST(rev_market_b AS DOUBLE) AS rev_market_b
FROM ad_fact"""
    q["ingest_audit"] = FACT_CTE + """
SELECT count(*) AS n_rows, count(DISTINCT activity_date) AS n_days,
       min(activity_date) AS first_day, max(activity_date) AS last_day FROM ad_fact"""
    q["product_date_extent"] = FACT_CTE + f"""
SELECT min(activity_date) AS first_day, max(activity_date) AS last_day,
       count(DISTINCT activity_date) AS n_days
FROM ad_fact WHERE {PRODUCT_ROWS}"""
    q["period_totals"] = totals_sql("a.d_max - 6", "a.d_max")
    q["mtd_totals"] = totals_sql("a.month_start", "a.d_max")
    q["mtd_totals_by_brand"] = totals_sql("a.month_start", "a.d_max",
                                          f"CAST(brand AS VARCHAR) = {_q(BRAND)}")
    q["mtd_basis_table"] = HEAD + f""",
t AS (SELECT {record_cols()} FROM (SELECT {SUM7} FROM ad_fact, anch a WHERE {MTD}) s)
SELECT 'SS' AS basis, impressions, clicks, cpc, ctr, cost, buy_ss AS purchases, rev_ss AS revenue,
       roas_ss AS roas FROM t
UNION ALL
SELECT 'DB', impressions, clicks, cpc, ctr, cost, buy_db, rev_db, roas_db FROM t"""
    cond = f"coalesce(CAST(brand AS VARCHAR) = {_q(DETAIL_BRAND)}, false)"
    sums_b = ", ".join(f"coalesce(sum(CASE WHEN {cond} THEN {m} END), 0) AS {m}" for m in
                       ("impressions", "clicks", "cost", "buy_ss", "rev_ss", "buy_db", "rev_db"))
    q["daily_detail"] = HEAD + f"""
SELECT strftime(activity_date, '%Y-%m-%d') AS day, activity_date, {record_cols()}
FROM (SELECT activity_date, {sums_b} FROM ad_fact, anch a WHERE {MTD} GROUP BY activity_date) t"""
    q["media_mtd"] = HEAD + f"""
SELECT channel, media, {record_cols()}
FROM (SELECT channel, media, {SUM7} FROM ad_fact, anch a WHERE {MTD} GROUP BY channel, media) t"""
    q["kpi_attainment"] = kpi_sql()
    q["campaign_mtd_top30"] = campaign_top_sql(MTD)
    q["campaign_top30_all"] = campaign_top_sql(ALLH)
    q["keyword_mtd_top20"] = keyword_top_sql(MTD)
    q["keyword_top20_all"] = keyword_top_sql(ALLH)
    q["creative_mtd_top20"] = creative_top_sql(MTD)
    q["creative_top20_all"] = creative_top_sql(ALLH)
    q["mtd_top_products"] = top_products_sql(MTD)
    q["top_products_all"] = top_products_sql(ALLH)
    q["media_top_products_mtd"] = media_top_products_sql(MTD)
    q["media_top_products_all"] = media_top_products_sql(ALLH)
    q["media_top_products_day"] = media_top_products_sql("activity_date = a.d_max")
    q["media_daily"] = media_daily_sql()
    q["promo_split"] = promo_sql()
    q["roas_trend"] = roas_trend_sql()
    q["product_top10"] = HEAD + PRODUCT_TOP10_CTE + "\nSELECT * FROM pt"
    q["product_top10_summary"] = HEAD + PRODUCT_TOP10_CTE + """
SELECT media, CAST(count_if(rev_delta > 0) AS BIGINT) AS n_up,
       CAST(count_if(rev_delta < 0) AS BIGINT) AS n_down,
  max(CASE WHEN gr = 1 THEN product END) AS top_gainer_1,
  max(CASE WHEN gr = 2 THEN product END) AS top_gainer_2
FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY rev_delta DESC NULLS LAST,
                                   product ASC NULLS FIRST) AS gr FROM pt) s
GROUP BY media"""
    q["multi_period"] = multi_period_sql("a.d_max", "a.d_max", "1")
    q["multi_period_week"] = multi_period_sql("a.d_max - 6", "a.d_max", "7")
    q["period_table"] = HEAD + f""",
own AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS s FROM orders WHERE o_orderdate IS NOT NULL),
ranges AS (SELECT s, CAST(s + 7 * CAST(month(s) AS INTEGER) - 1 AS DATE) AS e FROM own),
p AS (SELECT s, e FROM ranges UNION ALL SELECT CAST(s + 3650 AS DATE), CAST(e + 3650 AS DATE) FROM ranges)
SELECT s AS period_start, e AS period_end, {record_cols()}
FROM (SELECT p.s, p.e, {SUM7} FROM p LEFT JOIN ad_fact f ON f.activity_date BETWEEN p.s AND p.e GROUP BY p.s, p.e) t"""
    q["restated_days"] = HEAD + """,
tagged AS (
  SELECT 1 AS no, activity_date, cost, rev_ss, rev_db, buy_ss FROM ad_fact
  UNION ALL
  SELECT 2, activity_date, CASE WHEN media = 'NATION_3' AND buy_db = 1 THEN cost + 0.01 ELSE cost END, rev_ss, rev_db,
         buy_ss FROM ad_fact WHERE NOT coalesce(media = 'NATION_12' AND brand = 'F', false)
  UNION ALL
  SELECT 3, activity_date, cost, rev_ss, rev_db, buy_ss FROM ad_fact, anch WHERE activity_date < d_max),
per AS (SELECT no, activity_date, count(*) AS n, coalesce(sum(cost), 0) AS cost, coalesce(sum(rev_ss), 0) AS rev_ss,
               coalesce(sum(rev_db), 0) AS rev_db, coalesce(sum(buy_ss), 0) AS buy_ss FROM tagged GROUP BY ALL),
pairs AS (SELECT coalesce(b.no, a.no + 1) AS no, coalesce(b.activity_date, a.activity_date) AS activity_date,
                 a.n AS n_a, b.n AS n_b, a.cost AS cost_a, b.cost AS cost_b, a.rev_ss AS rev_ss_a, b.rev_ss AS rev_ss_b,
                 a.rev_db AS rev_db_a, b.rev_db AS rev_db_b, a.buy_ss AS buy_ss_a, b.buy_ss AS buy_ss_b
          FROM per a FULL JOIN per b ON b.no = a.no + 1 AND a.activity_date = b.activity_date)
SELECT 't' || no AS tag, 't' || (no - 1) AS previous_tag, activity_date,
       CASE WHEN n_a IS NULL THEN 'added' WHEN n_b IS NULL THEN 'removed' ELSE 'restated' END AS change,
       coalesce(n_a, 0) AS rows_before, coalesce(n_b, 0) AS rows_after, """ + ", ".join(
        f"CAST(coalesce({m}_{side}, 0) AS DOUBLE) AS {m}_{name}"
        for m in ("cost", "rev_ss", "rev_db", "buy_ss") for side, name in (("a", "before"), ("b", "after"))) + """
FROM pairs WHERE no BETWEEN 2 AND 3 AND (n_a, cost_a, rev_ss_a, rev_db_a, buy_ss_a)
  IS DISTINCT FROM (n_b, cost_b, rev_ss_b, rev_db_b, buy_ss_b)"""
    q["multi_period_delta"] = multi_period_delta_sql("ss")
    q["multi_period_delta_db"] = multi_period_delta_sql("db")
    q["period_delta"] = period_delta_core() + f"\nSELECT *, {dir3('delta')} AS direction FROM pd"
    q["daily_headline"] = daily_headline_sql()
    q["channel_headline"] = HEAD + (
        f"\nSELECT *, {dir2('rev_delta')} AS direction FROM "
        f"{cmp_sql(['section'], 'ss', fill=False, src=SECTIONED)} c")
    q["channel_drivers"] = HEAD + channel_drivers_cte() + \
        f"\nSELECT *, {dir2('rev_delta')} AS direction FROM cd"
    q["media_product_drivers"] = HEAD + channel_drivers_cte() + PRODUCT_DRIVERS_CTE + f"""
SELECT section, media_rank, media, rank, product,
       {trunc_sql('product', CFG.label_len_long)} AS product_label, {CMP_COLS},
       {dir2('rev_delta')} AS direction
FROM pd"""
    q["display_media_breakdown"] = HEAD + (
        f"\nSELECT *, {dir2('rev_delta')} AS direction FROM "
        f"{cmp_sql(['media'], 'db', 'media IN ' + _in(CFG.display_sub_media))} c")
    q["media_campaign_drivers"] = HEAD + campaign_drivers_cte(3) + "\nSELECT * FROM mc"
    q["media_summary"] = HEAD + f""",
top1 AS (
  SELECT media, {path_sql(CFG.path_fallback_summary)} AS key_campaign
  FROM ({topk_sql(cmp_sql(['media', 'campaign', 'ad_group'], 'db'), 'media',
                  infl(['campaign', 'ad_group']), 1)}) t)
SELECT s.media, s.rev_cur, s.rev_delta, s.cost_delta, s.roas_cur, s.roas_delta, s.influence,
       coalesce(top1.key_campaign, {_q(CFG.path_fallback_summary)}) AS key_campaign
FROM {cmp_sql(['media'], 'ss')} s LEFT JOIN top1 ON top1.media = s.media"""
    q["drilldown_tree"] = (HEAD + channel_drivers_cte() + PRODUCT_DRIVERS_CTE
                           + campaign_drivers_cte(3) + DISPLAY_CTE + f"""
SELECT section, 'media' AS level, CAST(NULL AS VARCHAR) AS parent, rank, media AS label,
       'ss' AS basis, {TREE_COLS} FROM cd
UNION ALL
SELECT section, 'product', media, rank, {trunc_sql('product', CFG.label_len_long)}, 'ss', {TREE_COLS}
FROM pd
UNION ALL
SELECT par.section, 'campaign', mc.media, mc.rank, mc.label, 'db',
       mc.rev_cur, mc.rev_delta, mc.cost_cur, mc.cost_delta, mc.buy_delta, mc.roas_cur, mc.roas_delta
FROM mc JOIN (SELECT section, media FROM cd) par ON par.media = mc.media
UNION ALL
SELECT par.section, 'display_sub_media', par.media, dm.rank, dm.media, 'db',
       dm.rev_cur, dm.rev_delta, dm.cost_cur, dm.cost_delta, dm.buy_delta, dm.roas_cur, dm.roas_delta
FROM dm JOIN (SELECT section, media FROM cd
              WHERE contains(media, {_q(CFG.display_marker)})) par ON TRUE""")
    in_brand = f"brand = {_q(BRAND)}"
    in_detail = f"brand = {_q(DETAIL_BRAND)}"
    q["keyword_mtd_top20_by_brand"] = keyword_top_sql(f"{ALLH} AND {in_detail}")
    q["creative_mtd_top20_by_brand"] = creative_top_sql(f"{ALLH} AND {in_detail}")
    keyword_rows = f"media IN {_in(CFG.keyword_media)} AND {valid_sql('keyword')}"
    creative_rows = f"media IN {_in(CFG.creative_media)} AND {valid_sql('creative')}"
    q["campaign_change_top20_by_brand"] = per_media_change_sql(["campaign", "ad_group"], "db", in_brand)
    q["keyword_change_top20_by_brand"] = per_media_change_sql(["keyword"], "ss", f"{keyword_rows} AND {in_brand}")
    q["creative_change_top20_by_brand"] = per_media_change_sql(["creative"], "db", f"{creative_rows} AND {in_brand}")
    q["creative_top20_of_campaign"] = creative_top_sql(
        f"{ALLH} AND campaign = {_q(CAMPAIGN)} AND ad_group = {_q(AD_GROUP)}")
    q["creative_change_of_group"] = per_media_change_sql(
        ["creative"], "db", f"{creative_rows} AND ad_group = {_q(AD_GROUP)}")
    q["product_gainers"] = product_movers_sql(False, True)
    q["product_losers"] = product_movers_sql(False, False)
    q["media_product_gainers"] = product_movers_sql(True, True)
    q["media_product_losers"] = product_movers_sql(True, False)
    q["campaign_change_top20"] = per_media_change_sql(["campaign", "ad_group"], "db", "TRUE")
    q["keyword_change_top20"] = per_media_change_sql(
        ["keyword"], "ss", f"media IN {_in(CFG.keyword_media)} AND {valid_sql('keyword')}")
    q["creative_change_top20"] = per_media_change_sql(
        ["creative"], "db", f"media IN {_in(CFG.creative_media)} AND {valid_sql('creative')}")
    pm = ("cost", "rev_ss", "rev_db", "buy_ss")
    both = """,
u AS (SELECT media, cost, rev_ss, rev_db, buy_ss, 'a' AS side FROM ad_fact
      UNION ALL
      SELECT media, {cost}, rev_ss, rev_db, buy_ss, 'b' AS side FROM ad_fact WHERE {where}),
per AS ("""
    per_of = lambda cost, where: FACT_CTE + both.format(cost=cost, where=where) + """
  SELECT media,
    """ + ",\n    ".join(
        [f"CAST(count(*) FILTER (WHERE side = '{x}') AS BIGINT) AS rows_{x}" for x in "ab"]
        + [f"coalesce(sum(CASE WHEN side = '{x}' THEN {m} END), 0) AS {m}_{x}"
           for x in "ab" for m in pm]) + """
  FROM u GROUP BY media)"""
    per_media = per_of("cost", "TRUE")
    ok_per = " AND ".join(["rows_a = rows_b"] + [
        f"abs({m}_a - {m}_b) < 0.000001" for m in pm])
    verdict = f"""
SELECT media, rows_a, rows_b, {', '.join(f'CAST({m}_{x} AS DOUBLE) AS {m}_{x}' for x in 'ab' for m in pm)},
       {ok_per} AS ok
FROM per"""
    q["snapshot_parity"] = per_media + verdict
    q["snapshot_parity_diff"] = per_of(
        "CASE WHEN media = 'NATION_3' AND buy_db = 1 THEN CAST(cost + 0.01 AS DECIMAL(18,4)) ELSE cost END",
        "NOT coalesce(media = 'NATION_12' AND brand = 'F', false)") + verdict
    q["snapshot_parity_totals"] = per_media + f""",
tot AS (
  SELECT CAST(sum(rows_a) AS BIGINT) AS rows_a, CAST(sum(rows_b) AS BIGINT) AS rows_b,
         {', '.join(f'sum({m}_{x}) AS {m}_{x}' for x in 'ab' for m in pm)},
         coalesce(bool_and({ok_per}), true) AS media_ok
  FROM per)
SELECT rows_a, rows_b, {', '.join(f'CAST({m}_{x} AS DOUBLE) AS {m}_{x}' for x in 'ab' for m in pm)},
       media_ok, {ok_per} AS totals_ok
FROM tot"""
    q["dimension_values"] = FACT_CTE + "\n" + "\nUNION\n".join(
        f"SELECT {_q(d)} AS dimension, CAST({d} AS VARCHAR) AS value FROM ad_fact WHERE {d} IS NOT NULL"
        for d in ("brand", "media", "campaign", "ad_group"))
    q["cascading_filter"] = FACT_CTE + f""",
trip AS (
  SELECT DISTINCT media, CAST(campaign AS VARCHAR) AS campaign, CAST(ad_group AS VARCHAR) AS ad_group
  FROM ad_fact
  WHERE media IN {_in(CFG.creative_media)} AND {valid_sql('creative')} AND campaign IS NOT NULL),
named AS (SELECT media, campaign, count(ad_group) AS n FROM trip GROUP BY media, campaign)
SELECT trip.media, trip.campaign, trip.ad_group FROM trip
JOIN named ON named.media = trip.media AND named.campaign = trip.campaign
WHERE trip.ad_group IS NOT NULL OR named.n = 0"""
    q["valid_product_filter"] = FACT_CTE + f"""
SELECT activity_date, channel, media, product, CAST(rev_ss AS DOUBLE) AS rev_ss, buy_ss FROM ad_fact
WHERE {valid_sql('product', True)}"""
    q["label_truncate"] = FACT_CTE + f"""
SELECT product, {trunc_sql('product', CFG.label_len_long)} AS label_long,
       {trunc_sql('product', CFG.label_len_short)} AS label_short,
       CAST(length(product) AS BIGINT) AS n_chars
FROM (SELECT DISTINCT product FROM ad_fact WHERE product IS NOT NULL) p"""
    pct = "metric IN ('ctr', 'roas_ss', 'roas_db')"
    q["format_metrics"] = period_delta_core() + f"""
SELECT metric,
  CASE WHEN metric = 'ctr' THEN format('{{:.3f}}%', round_even(base_value, 3))
       WHEN {pct} THEN format('{{:.1f}}%', round_even(base_value, 1)) ELSE {fmt_money('base_value')} END
    AS value_text,
  CASE WHEN {pct} THEN format('{{:+.1f}}p', round_even(delta, 1)) ELSE {fmt_signed_money('delta')} END
    AS delta_text,
  {dir3('delta')} AS direction
FROM pd"""
    return q


ORACLE_SQL = build()
