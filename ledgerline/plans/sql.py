"""DuckDB SQL of the registered queries, on the same views as plans/views.py."""

VIEWS = """
candles AS (
  SELECT 'A' || (CAST(left(o_orderpriority, 1) AS INT) - 1) AS asset_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
    arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, o_orderkey) AS "close", count(*) AS volume
  FROM orders GROUP BY 1, 2),
news AS (
  SELECT 'A' || (event_id % 5) AS asset_id, CASE WHEN event_id % 11 <> 0 THEN 'n' || event_id END AS article_id,
    ts - INTERVAL 9131 DAY AS published_at,
    CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat_ws(' ', event_type, props) END AS headline,
    CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' user ' || user_id END AS summary,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS source,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'ftp://x' ELSE 'https://news.example/' || (event_id // 2) END AS url,
    CASE WHEN event_id % 29 = 0 THEN 'en_US' ELSE 'en' END AS language, event_id AS ordinal, value
  FROM events),
scored_news AS (
  SELECT asset_id, 'n' || ordinal AS article_id, published_at,
    CASE WHEN ordinal % 31 = 0 THEN 2.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100)) END AS sentiment_score,
    CASE WHEN ordinal % 37 <> 0 THEN abs(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100))) END AS confidence,
    CASE WHEN ordinal % 41 = 0 THEN '' ELSE 'linear' END AS model_name
  FROM news),
lines AS (
  SELECT 'A' || (CAST(left(o_orderpriority, 1) AS INT) - 1) AS asset_id, l_shipdate::DATE AS d,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS revenue, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net,
    CAST(round(l_quantity * 100) AS BIGINT) AS flow, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
periods AS (
  SELECT 'annual' AS report_type, (date_trunc('year', d) + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE AS fiscal_date_end, * FROM lines
  UNION ALL
  SELECT 'quarterly', (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE, * FROM lines),
fundamentals AS (
  SELECT asset_id, report_type, fiscal_date_end,
    CASE WHEN month(fiscal_date_end) % 2 = 0 THEN fiscal_date_end + 30 END AS reported_date,
    CAST(sum(revenue) AS BIGINT) / 100.0::DOUBLE AS revenue, CAST(sum(net) AS BIGINT) / 100.0::DOUBLE AS net_income,
    CAST(sum(flow) AS BIGINT) / 100.0::DOUBLE AS operating_cash_flow,
    CASE WHEN year(fiscal_date_end) % 3 <> 0 THEN CAST(sum(tax) AS BIGINT) / 100.0::DOUBLE END AS total_shareholder_equity,
    CAST(count(*) AS DOUBLE) AS total_liabilities, 'lines' AS source
  FROM periods GROUP BY 1, 2, 3),
daily AS (
  SELECT asset_id, published_at::DATE AS day, avg(sentiment_score) AS sentiment_score, count(*) AS n_articles,
    stddev_pop(sentiment_score) AS sentiment_std
  FROM scored_news WHERE sentiment_score BETWEEN -1 AND 1 GROUP BY 1, 2)
"""

INDICATORS = """
bars AS (
  SELECT *, row_number() OVER w - 1 AS rn, "close" - lag("close") OVER w AS delta, "close" / lag("close") OVER w - 1 AS change
  FROM candles WINDOW w AS (PARTITION BY asset_id ORDER BY ts)),
seeds AS (
  SELECT *, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss,
    avg("close") OVER (w ROWS 9 PRECEDING) AS m10, avg("close") OVER (w ROWS 11 PRECEDING) AS m12,
    avg("close") OVER (w ROWS 25 PRECEDING) AS m26, avg("close") OVER (w ROWS 49 PRECEDING) AS m50,
    avg("close") OVER (w ROWS 99 PRECEDING) AS m100, avg("close") OVER (w ROWS 199 PRECEDING) AS m200,
    avg(CASE WHEN delta IS NULL THEN NULL ELSE greatest(delta, 0) END) OVER (w ROWS 13 PRECEDING) AS mg,
    avg(CASE WHEN delta IS NULL THEN NULL ELSE greatest(-delta, 0) END) OVER (w ROWS 13 PRECEDING) AS ml,
    CASE WHEN count(change) OVER (w ROWS 19 PRECEDING) = 20 THEN stddev_samp(change) OVER (w ROWS 19 PRECEDING) END AS volatility_20d
  FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY ts)),
rec AS (
  SELECT asset_id, rn, NULL::DOUBLE e10, NULL::DOUBLE e12, NULL::DOUBLE e26, NULL::DOUBLE e50, NULL::DOUBLE e100, NULL::DOUBLE e200,
    NULL::DOUBLE g, NULL::DOUBLE l FROM seeds WHERE rn = 0
  UNION ALL
  SELECT s.asset_id, s.rn,
    CASE WHEN s.rn = 9 THEN m10 ELSE s."close" * 2 / 11 + e10 * (1 - 2.0::DOUBLE / 11) END,
    CASE WHEN s.rn = 11 THEN m12 ELSE s."close" * 2 / 13 + e12 * (1 - 2.0::DOUBLE / 13) END,
    CASE WHEN s.rn = 25 THEN m26 ELSE s."close" * 2 / 27 + e26 * (1 - 2.0::DOUBLE / 27) END,
    CASE WHEN s.rn = 49 THEN m50 ELSE s."close" * 2 / 51 + e50 * (1 - 2.0::DOUBLE / 51) END,
    CASE WHEN s.rn = 99 THEN m100 ELSE s."close" * 2 / 101 + e100 * (1 - 2.0::DOUBLE / 101) END,
    CASE WHEN s.rn = 199 THEN m200 ELSE s."close" * 2 / 201 + e200 * (1 - 2.0::DOUBLE / 201) END,
    CASE WHEN s.rn = 14 THEN mg ELSE gain / 14 + r.g * (1 - 1.0::DOUBLE / 14) END,
    CASE WHEN s.rn = 14 THEN ml ELSE loss / 14 + r.l * (1 - 1.0::DOUBLE / 14) END
  FROM rec r JOIN seeds s ON s.asset_id = r.asset_id AND s.rn = r.rn + 1),
macds AS (
  SELECT asset_id, rn, e12 - e26 AS macd, avg(e12 - e26) OVER (PARTITION BY asset_id ORDER BY rn ROWS 8 PRECEDING) AS m9 FROM rec),
sig AS (
  SELECT asset_id, rn, m9 AS s FROM macds WHERE rn = 33
  UNION ALL
  SELECT m.asset_id, m.rn, m.macd / 5 + s.s * (1 - 2.0::DOUBLE / 10) FROM sig s JOIN macds m ON m.asset_id = s.asset_id AND m.rn = s.rn + 1),
indicators AS (
  SELECT s.asset_id, s.ts, 100 * r.g / nullif(r.g + r.l, 0) AS rsi_14, m.macd, sig.s AS macd_signal, e10 AS ema_10, e50 AS ema_50,
    e100 AS ema_100, e200 AS ema_200, volatility_20d, high - low AS candle_range, abs("close" - open) AS candle_body
  FROM seeds s JOIN rec r USING (asset_id, rn) JOIN macds m USING (asset_id, rn) JOIN sig USING (asset_id, rn)
  WHERE e200 IS NOT NULL AND r.g + r.l <> 0 AND volatility_20d IS NOT NULL)
"""
NAMES = ["rsi_14", "macd", "macd_signal", "ema_10", "ema_50", "ema_100", "ema_200", "volatility_20d", "candle_range", "candle_body"]
MEASURES = ["revenue", "net_income", "operating_cash_flow", "total_shareholder_equity", "total_liabilities"]


def rounded(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


def with_views(body: str, indicators: bool = False, more: str = "") -> str:
    parts = [VIEWS, *([INDICATORS] if indicators else []), *([more] if more else [])]
    return f"WITH RECURSIVE {', '.join(p.strip() for p in parts)}\n{body}"


def long_report(view: str, by: str, date: str, keys: list[str], numeric: list[str], data: list[str], rules: dict[str, str], business: bool, columns: list[str], dtypes: tuple[str, ...] = ()) -> str:
    """A quality report as (by, section, name, value); rules: violation by metric name."""
    null = lambda c: f"({c} IS NULL OR isnan(CAST({c} AS DOUBLE)))" if c in numeric else f"({c} IS NULL)"
    any_of = lambda xs: "(" + " OR ".join([*xs, "false"]) + ")"
    metrics = [("size", "rows", "count(*)"), ("size", "rows_with_nulls", f"count_if({any_of(map(null, data))})")]
    metrics += [("nulls", c, f"count_if(coalesce({null(c)}, false))") for c in data]
    metrics += [("zeros", c, f"count_if(coalesce({c} = 0, false))") for c in numeric]
    metrics += [("size", "rows_with_zeros", f"count_if({any_of(f'coalesce({c} = 0, false)' for c in numeric)})")]
    metrics += [("nonfinite", c, f"count_if({null(c)} OR coalesce(isinf(CAST({c} AS DOUBLE)), false))") for c in numeric]
    metrics += [("rules", n, f"count_if({v})") for n, v in rules.items()]
    null_key = any_of(map(null, [by, *keys]))
    metrics += [("keys", "null_key_rows", f"count_if({null_key})")]
    metrics += [("rules", "rows_with_violations", f"count_if({any_of([null_key, *rules.values()])})")]
    for c in numeric:
        x = f"CAST({c} AS DOUBLE)"
        metrics += [(f"summary:{c}", n, f"{f}({x})") for n, f in (("count", "count"), ("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
        metrics += [(f"summary:{c}", f"{q}%", f"quantile_cont({x}, {q / 100})") for q in (25, 50, 75)]
    n_columns = len(columns) + 1
    rows = " UNION ALL ".join(f"SELECT {by} AS asset_id, '{s}' AS section, '{n}' AS name, CAST({e} AS DOUBLE) AS value FROM {view} GROUP BY 1" for s, n, e in metrics)
    key = ", ".join(k for k in keys if k != by)
    weekdays = "(isodow(d) < 6)" if business else "true"
    return f"""
    {rows}
    UNION ALL SELECT asset_id, 'keys', 'duplicate_rows', CAST(sum(n - 1) AS DOUBLE) FROM (SELECT {by} AS asset_id, {key}, count(*) n FROM {view} GROUP BY ALL) GROUP BY 1
    UNION ALL SELECT {by}, 'dates', 'unparseable', CAST(count_if({date} IS NULL) AS DOUBLE) FROM {view} GROUP BY 1
    UNION ALL SELECT {by}, 'per_day', CAST({date}::DATE AS VARCHAR), CAST(count(*) AS DOUBLE) FROM {view} WHERE {date} IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT {by}, 'per_weekday', CAST(isodow({date}) - 1 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM {view} WHERE {date} IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT {by}, 'per_year', CAST(year({date}) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM {view} WHERE {date} IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT asset_id, 'dates', unnest(['gaps', 'largest_gap']), unnest([CAST(count_if(gap > 1) AS DOUBLE), CAST(max(CASE WHEN gap > 1 THEN gap END) AS DOUBLE)])
      FROM (SELECT asset_id, d - lag(d) OVER (PARTITION BY asset_id ORDER BY d) AS gap FROM (SELECT DISTINCT {by} AS asset_id, {date}::DATE AS d FROM {view} WHERE {date} IS NOT NULL)) GROUP BY 1
    UNION ALL SELECT {by}, 'dates', unnest(['first_day', 'last_day']), unnest([CAST(min({date}::DATE) - DATE '1970-01-01' AS DOUBLE), CAST(max({date}::DATE) - DATE '1970-01-01' AS DOUBLE)]) FROM {view} GROUP BY 1
    UNION ALL SELECT asset_id, 'dates', 'missing_days', CAST(count_if(NOT seen) AS DOUBLE) FROM (
      SELECT b.asset_id, x.d::DATE AS d, (b.asset_id, x.d::DATE) IN (SELECT ({by}, {date}::DATE) FROM {view} WHERE {date} IS NOT NULL) AS seen
      FROM (SELECT {by} AS asset_id, min({date}::DATE) lo, max({date}::DATE) hi FROM {view} GROUP BY 1) b, LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS d) x)
      WHERE {weekdays} GROUP BY 1
    UNION ALL SELECT NULL, 'schema', 'columns', {float(n_columns)}
    """ + "".join(f" UNION ALL SELECT NULL, 'column', '{c}', {float(i)}" for i, c in enumerate([by, *columns])) + "".join(f" UNION ALL SELECT NULL, 'dtype', '{c}', 0.0" for c in dtypes)
