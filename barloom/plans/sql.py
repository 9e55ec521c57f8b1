"""Common table expressions of the check queries, in DuckDB's SQL."""

from __future__ import annotations

BARS = """
lots AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_orderkey ok, l_linenumber ln,
                l_partkey pk, l_suppkey sk, l_quantity q, l_extendedprice ep, l_discount d FROM lineitem),
walk AS (SELECT *, sum(cast(round(d * 100) AS BIGINT) - 5) OVER (PARTITION BY symbol
                ORDER BY ts, ok, ln, pk, sk, q, ep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM lots),
priced AS (SELECT *, round(100 * exp(0.002 * cum), 4) AS px, row(ok, ln, pk, sk, q, ep) AS k FROM walk),
bars AS MATERIALIZED (SELECT symbol, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
                arg_max(px, k) AS close, sum(q) AS volume FROM priced GROUP BY symbol, ts),
b AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::INT AS i,
                count(*) OVER (PARTITION BY symbol) AS n FROM bars)
"""

NEWS = """
news AS MATERIALIZED (
  SELECT *, sha256(headline || chr(0) || body) AS content_hash FROM (
    SELECT doc_id::VARCHAR AS item_id, ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][(doc_id % 6 + 1)::INT] AS symbol,
           make_timestamp((789004800 + (doc_id * 7919 % 2490) * 86400 + doc_id * 104729 % 86400) * 1000000) AS published_at,
           make_timestamp((789004800 + (doc_id * 7919 % 2490) * 86400 + doc_id * 104729 % 86400 + doc_id % 72 * 3600) * 1000000) AS first_seen_at,
           substr(coalesce(text, ''), 1, 60) AS headline, coalesce(text, '') AS body, coalesce(source, '') AS source
    FROM documents)),
ann AS MATERIALIZED (
  SELECT *, CASE WHEN seed % 17 = 0 THEN 'failed' ELSE 'ok' END AS status, (seed % 2001 - 1000) / 1000.0::DOUBLE AS sentiment,
         (seed % 1001) / 1000.0::DOUBLE AS relevance,
         ['earnings', 'guidance', 'analyst_rating', 'ma', 'legal_regulatory', 'product', 'management_change', 'macro', 'other'][(seed % 9 + 1)::INT] AS event_type,
         (greatest(1, chars // 4) * 1.0::DOUBLE + 32 * 5.0::DOUBLE) / 1000000 * 0.5 AS cost_usd
  FROM (SELECT content_hash, ('0x' || substr(content_hash, 1, 8))::BIGINT AS seed,
               min(length(headline)) + min(length(body)) AS chars FROM news GROUP BY content_hash))
"""

INDICATORS = """
st AS MATERIALIZED (
  SELECT *, close - lag(close) OVER w AS d, close / lag(close) OVER w - 1 AS ret,
         CASE WHEN i >= 19 THEN avg(close) OVER w20 END AS sma_20, CASE WHEN i >= 49 THEN avg(close) OVER w50 END AS sma_50,
         CASE WHEN i >= 19 THEN avg(volume) OVER w20 END AS volume_ma_20, CASE WHEN i >= 19 THEN stddev_samp(close) OVER w20 END AS std_20
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i),
       w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       w50 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
rec AS (
  SELECT symbol, i, close AS e12, close AS e20, close AS e26, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS s FROM st WHERE i = 0
  UNION ALL
  SELECT symbol, i, e12, e20, e26, g, l, CASE WHEN i >= 25 THEN coalesce(s * 0.8::DOUBLE + (e12 - e26) * 0.2::DOUBLE, e12 - e26) END FROM (
    SELECT st.symbol, st.i, rec.e12 * (11::DOUBLE / 13) + st.close * (2::DOUBLE / 13) AS e12, rec.e20 * (19::DOUBLE / 21) + st.close * (2::DOUBLE / 21) AS e20,
           rec.e26 * (25::DOUBLE / 27) + st.close * (2::DOUBLE / 27) AS e26,
           coalesce(rec.g * (13::DOUBLE / 14) + greatest(st.d, 0) / 14, greatest(st.d, 0)) AS g,
           coalesce(rec.l * (13::DOUBLE / 14) + greatest(-st.d, 0) / 14, greatest(-st.d, 0)) AS l, rec.s
    FROM rec JOIN st ON st.symbol = rec.symbol AND st.i = rec.i + 1)),
ind AS MATERIALIZED (
  SELECT st.*, CASE WHEN st.i >= 19 THEN e20 END AS ema_20, CASE WHEN st.i >= 25 THEN e12 - e26 END AS macd,
         CASE WHEN st.i >= 33 THEN s END AS macd_signal,
         CASE WHEN st.i >= 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi_14
  FROM st JOIN rec USING (symbol, i))
"""

STEPS = INDICATORS.split("rec AS (")[0].strip().rstrip(",")
#: The windows without the recurrences, for strategies that need only the bands.
BANDS = STEPS.replace("st AS", "ind AS", 1)

FEATURES = """
feat AS MATERIALIZED (
  SELECT *, close / sma_20 - 1 AS f_close_sma20, close / sma_50 - 1 AS f_close_sma50, sma_20 / sma_50 - 1 AS f_sma20_sma50,
         close / ema_20 - 1 AS f_close_ema20, rsi_14 / 100 AS f_rsi, macd / close AS f_macd, (macd - macd_signal) / close AS f_macd_gap,
         volume / volume_ma_20 - 1 AS f_volume, close / lag(close, 5) OVER w - 1 AS f_ret_5, close / lag(close, 10) OVER w - 1 AS f_ret_10,
         CASE WHEN i >= 20 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS f_vol_20
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY i)),
lab0 AS (
  SELECT *, lead(open, 6) OVER w / lead(open, 1) OVER w - 1 AS fwd_return, lead(ts, 1) OVER w AS label_start_ts, lead(ts, 6) OVER w AS label_end_ts
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY i)),
lab1 AS (
  SELECT *, CASE WHEN fwd_return > {band} THEN 1.0 WHEN fwd_return < -{band} THEN 0.0 END AS label,
         count(fwd_return) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS concurrency FROM lab0),
lab AS MATERIALIZED (
  SELECT *, CASE WHEN fwd_return IS NOT NULL THEN avg(1.0 / nullif(concurrency, 0)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) END AS weight,
         f_close_sma50 IS NOT NULL AND f_macd_gap IS NOT NULL AND f_vol_20 IS NOT NULL AND f_rsi IS NOT NULL AND f_volume IS NOT NULL AND f_ret_10 IS NOT NULL AS ready
  FROM lab1),
panel AS MATERIALIZED (SELECT *, ts AS decision_ts FROM lab WHERE ready AND fwd_return IS NOT NULL AND label IS NOT NULL)
"""


def features(band: float = 0.0) -> str:
    return FEATURES.replace("{band}", repr(band))


MEAN_REVERSION = """
sig AS MATERIALIZED (
  SELECT *, CASE WHEN sma_20 IS NULL OR std_20 IS NULL THEN 0 WHEN close < sma_20 - {entry} * std_20 THEN 1 WHEN close >= sma_20 - {leave} * std_20 THEN -1 ELSE 0 END AS signal
  FROM ind)
"""


def mean_reversion(entry: float = 2.0, leave: float = 0.0) -> str:
    return MEAN_REVERSION.replace("{entry}", repr(entry)).replace("{leave}", repr(leave))


TREND = """
sig AS MATERIALIZED (
  SELECT *, CASE WHEN sma_20 IS NULL OR sma_50 IS NULL OR rsi_14 IS NULL OR macd IS NULL OR macd_signal IS NULL OR volume_ma_20 IS NULL THEN 0
    WHEN sma_20 > sma_50 AND close > sma_20 AND rsi_14 BETWEEN 45 AND 75 AND macd > macd_signal AND volume > volume_ma_20 THEN 1
    WHEN sma_20 < sma_50 OR close < sma_20 OR rsi_14 > 80 OR macd < macd_signal THEN -1 ELSE 0 END AS signal
  FROM ind)
"""

HOLD = "sig AS MATERIALIZED (SELECT *, 1 AS signal FROM ind)"


def fold(fraction: str = "0.95", stop: str = "NULL", target: str = "NULL", cutoff: str = "NULL", source: str = "sig", keys: str = "symbol", signal: str = "signal", more: str = "") -> str:
    """The replay as a recursion: one row of state per run and bar. ``keys`` may add run columns before symbol.

    ``signal`` may use ``qty``, ``held`` (bars that the position is open) and the columns ``more`` of the source.
    """
    more_cols = "".join(f", s.{m.strip()}" for m in more.split(",") if m.strip())
    on = " AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""
src AS MATERIALIZED (SELECT *, {fraction} AS fraction, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS j,
                            count(*) OVER (PARTITION BY {keys}) AS m FROM {source}),
fold AS (
  SELECT DISTINCT {keys}, -1::BIGINT AS j, NULL::TIMESTAMP AS ts, 100000::DOUBLE AS cash, 0::DOUBLE AS qty, 0::DOUBLE AS entry, 0 AS ord,
         0.95::DOUBLE AS share, 100000::DOUBLE AS peak, false AS halted, 100000::DOUBLE AS equity, 0::DOUBLE AS pv,
         0 AS did, 0::DOUBLE AS gross, false AS forced, 0::DOUBLE AS fgross, 0 AS held FROM src
  UNION ALL
  SELECT {keys}, j, ts, cash, qty, CASE WHEN qty > 0 THEN entry ELSE 0 END,
         CASE WHEN j = m - 1 THEN 0 WHEN lvl THEN -1 WHEN trip AND qty > 0 THEN -1 WHEN ({signal}) < 0 THEN -1 WHEN ({signal}) > 0 AND NOT (halted OR trip) THEN 1 ELSE 0 END,
         fraction, peak, halted OR trip, equity, pv, did, gross, forced, fgross, held
  FROM (
    SELECT *, coalesce(j < m - 1 AND qty > 0 AND (close <= entry * (1 - {stop}) OR close >= entry * (1 + {target})), false) AS lvl,
           coalesce(j < m - 1 AND NOT halted AND (peak - equity) / peak >= {cutoff}, false) AS trip
    FROM (
      SELECT *, CASE WHEN qty > 0 THEN held0 + 1 ELSE 0 END AS held, cash + qty * close AS equity, qty * close AS pv, greatest(peak0, cash + qty * close) AS peak
      FROM (
        SELECT * EXCLUDE (cash1, qty1), CASE WHEN j = m - 1 AND qty1 > 0 THEN cash1 + qty1 * close * (1 - 5.0::DOUBLE / 10000) * (1 - 5.0::DOUBLE / 10000) ELSE cash1 END AS cash,
               CASE WHEN j = m - 1 THEN 0 ELSE qty1 END AS qty, j = m - 1 AND qty1 > 0 AS forced,
               CASE WHEN j = m - 1 THEN qty1 * close * (1 - 5.0::DOUBLE / 10000) ELSE 0 END AS fgross
        FROM (
          SELECT {cols}, s.j, s.m, s.ts, s.close, s.signal, s.fraction{more_cols}, f.held AS held0, f.peak AS peak0, f.halted,
                 CASE WHEN f.ord = 1 AND f.qty = 0 AND f.share > 0 THEN s.open * (1 + 5.0::DOUBLE / 10000) ELSE f.entry END AS entry,
                 CASE WHEN f.ord = 1 AND f.qty = 0 THEN f.cash - f.cash * f.share
                      WHEN f.ord = -1 AND f.qty > 0 THEN f.cash + f.qty * s.open * (1 - 5.0::DOUBLE / 10000) * (1 - 5.0::DOUBLE / 10000) ELSE f.cash END AS cash1,
                 CASE WHEN f.ord = 1 AND f.qty = 0 THEN f.cash * f.share / (s.open * (1 + 5.0::DOUBLE / 10000) * (1 + 5.0::DOUBLE / 10000))
                      WHEN f.ord = -1 THEN 0 ELSE f.qty END AS qty1,
                 CASE WHEN f.ord = 1 AND f.qty = 0 AND f.share > 0 THEN 1 WHEN f.ord = -1 AND f.qty > 0 THEN -1 ELSE 0 END AS did,
                 CASE WHEN f.ord = 1 AND f.qty = 0 THEN f.cash * f.share / (1 + 5.0::DOUBLE / 10000)
                      WHEN f.ord = -1 AND f.qty > 0 THEN f.qty * s.open * (1 - 5.0::DOUBLE / 10000) ELSE 0 END AS gross
          FROM fold f JOIN src s ON {on} AND s.j = f.j + 1))))),
curve AS MATERIALIZED (SELECT *, equity / lag(equity) OVER (PARTITION BY {keys} ORDER BY j) - 1 AS eret,
                              max(equity) OVER (PARTITION BY {keys} ORDER BY j) AS top FROM fold WHERE j >= 0),
tfills AS MATERIALIZED (
  SELECT {keys}, ts, CASE WHEN did > 0 THEN 'BUY' ELSE 'SELL' END AS side, gross, row_number() OVER (PARTITION BY {keys} ORDER BY j, late) - 1 AS seq FROM (
    SELECT {keys}, ts, j, did, gross, 0 AS late FROM fold WHERE did <> 0
    UNION ALL SELECT {keys}, ts, j, -1, fgross, 1 FROM fold WHERE forced)),
trips AS MATERIALIZED (
  SELECT *, gross - gross * 5.0::DOUBLE / 10000 - (bgross + bgross * 5.0::DOUBLE / 10000) AS pnl, epoch(ts - bts) / 86400 AS days FROM (
    SELECT *, lag(side) OVER w AS bside, lag(gross) OVER w AS bgross, lag(ts) OVER w AS bts FROM tfills WINDOW w AS (PARTITION BY {keys} ORDER BY seq))
  WHERE side = 'SELL' AND bside = 'BUY')
"""


def equity_stats(keys: str = "symbol") -> str:
    """The aggregates of equity_stats(), over ``curve``."""
    return f"""
stats AS MATERIALIZED (
  SELECT {keys}, count(*) AS n, arg_max(equity, j) AS final_equity, (arg_max(equity, j) - 100000) / 100000 * 100 AS total_return_pct,
         CASE WHEN count(*) > 1 AND arg_max(equity, j) > 0 THEN (pow(arg_max(equity, j) / 100000, 1 / greatest((count(*) - 1) / 252.0::DOUBLE, 1)) - 1) * 100 ELSE 0 END AS annualised_return_pct,
         greatest(0, -min(equity / top - 1) * 100) AS max_drawdown_pct,
         CASE WHEN count(eret) >= 2 AND stddev_samp(eret) > 0 THEN avg(eret) / stddev_samp(eret) * sqrt(252) ELSE 0 END AS sharpe,
         CASE WHEN count(eret) >= 2 AND sum(CASE WHEN eret < 0 THEN eret * eret END) > 0
              THEN avg(eret) / sqrt(sum(CASE WHEN eret < 0 THEN eret * eret END) / count(eret)) * sqrt(252) ELSE 0 END AS sortino,
         count(*) FILTER (pv > 0) / count(*)::DOUBLE * 100 AS exposure_pct
  FROM curve GROUP BY {keys}),
tstats AS MATERIALIZED (
  SELECT {keys}, count(*) AS num_trades, count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100 AS win_rate_pct,
         CASE WHEN sum(pnl) FILTER (pnl < 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0)
              WHEN sum(pnl) FILTER (pnl > 0) > 0 THEN 1e9 ELSE 0 END AS profit_factor,
         coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss,
         avg(days) AS avg_holding_days, sum(pnl) AS realised_pnl
  FROM trips GROUP BY {keys})
"""


ARRIVE = """
cut0 AS (SELECT symbol, ts, i, lag(timezone('UTC', timezone('America/New_York', date_trunc('day', ts) + INTERVAL 16 HOUR)), 1) OVER (PARTITION BY symbol ORDER BY i) AS cutoff FROM b),
cut AS MATERIALIZED (SELECT symbol, ts, i, cutoff, lag(cutoff) OVER (PARTITION BY symbol ORDER BY i) AS prior FROM cut0 WHERE cutoff IS NOT NULL),
anews AS MATERIALIZED (
  SELECT n.item_id, n.symbol, n.content_hash, greatest(n.published_at, n.first_seen_at) AS available, a.sentiment, a.relevance
  FROM news n JOIN ann a USING (content_hash) WHERE a.status = 'ok'),
arr AS MATERIALIZED (
  SELECT a.*, c.i FROM anews a JOIN cut c ON a.symbol = c.symbol AND a.available <= c.cutoff AND (c.prior IS NULL OR a.available > c.prior)),
nb AS MATERIALIZED (
  SELECT b.symbol, b.ts, b.i, count(arr.item_id) AS n_news, coalesce(sum(arr.sentiment), 0) AS sentiment_sum,
         count(*) FILTER (arr.relevance >= 0.5) AS n_events
  FROM b LEFT JOIN arr ON arr.symbol = b.symbol AND arr.i = b.i GROUP BY b.symbol, b.ts, b.i),
dec AS (
  SELECT symbol, i, sentiment_sum AS acc FROM nb WHERE i = 0
  UNION ALL SELECT nb.symbol, nb.i, dec.acc * pow(0.5, 0.2) + nb.sentiment_sum FROM dec JOIN nb ON nb.symbol = dec.symbol AND nb.i = dec.i + 1),
nf AS MATERIALIZED (
  SELECT nb.*, (n_news > 0)::INT::DOUBLE AS n_has_news,
         coalesce(least(50, i - max(CASE WHEN n_news > 0 THEN i END) OVER (PARTITION BY symbol ORDER BY i)) / 50.0::DOUBLE, 1.0) AS n_days_since,
         dec.acc AS n_decayed,
         CASE WHEN sum(n_news) OVER w20 > 0 THEN sum(sentiment_sum) OVER w20 / sum(n_news) OVER w20 ELSE 0 END AS n_mean_20,
         CASE WHEN stddev_pop(n_news) OVER w20 > 0 THEN (n_news - avg(n_news) OVER w20) / stddev_pop(n_news) OVER w20 ELSE 0 END AS n_volume_z,
         (sum(n_events) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0)::INT::DOUBLE AS n_event
  FROM nb JOIN dec USING (symbol, i) WINDOW w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def rounded(cols: str, source: str, digits: int = 6) -> str:
    """Select ``cols``, rounding those that are marked with a leading tilde."""
    out = [f"round({c[1:]}, {digits}) + 0 AS {c[1:]}" if c.startswith("~") else c for c in (x.strip() for x in cols.split(","))]
    return f"SELECT {', '.join(out)} FROM {source}"
