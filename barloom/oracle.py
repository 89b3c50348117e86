"""Building blocks of the equivalent SQL, for DuckDB."""

from __future__ import annotations

BARS = """
bars AS (
  SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, arg_min(l_extendedprice, k) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, arg_max(l_extendedprice, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""

#: The same by supplier and day.
SUPPLIERS = """
bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice, k) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, arg_max(l_extendedprice, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) GROUP BY 1, 2)"""

#: Recursive averages are folds over the list of all values so far.
INDICATORS = """
i0 AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY ticker) AS cnt, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
i1 AS (SELECT *, greatest(coalesce(close - pc, 0), 0) AS up, greatest(-coalesce(close - pc, 0), 0) AS dn, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM i0 WHERE cnt >= 50),
i2 AS (SELECT *, list(close) OVER u AS lc, list(up) OVER u AS lu, list(dn) OVER u AS ld, list(tr) OVER u AS lt FROM i1
       WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
i3 AS (SELECT *,
  CASE WHEN n >= 9 THEN list_reduce(lc, lambda a, x: a * 0.8 + x * 0.2) END AS ema_9,
  CASE WHEN n >= 21 THEN list_reduce(lc, lambda a, x: a * (20.0::DOUBLE / 22) + x * (2.0::DOUBLE / 22)) END AS ema_21,
  CASE WHEN n >= 50 THEN list_reduce(lc, lambda a, x: a * (49.0::DOUBLE / 51) + x * (2.0::DOUBLE / 51)) END AS ema_50,
  CASE WHEN n >= 26 THEN list_reduce(lc, lambda a, x: a * (11.0::DOUBLE / 13) + x * (2.0::DOUBLE / 13)) - list_reduce(lc, lambda a, x: a * (25.0::DOUBLE / 27) + x * (2.0::DOUBLE / 27)) END AS macd,
  CASE WHEN n >= 14 THEN list_reduce(lu, lambda a, x: (13 * a + x) / 14) END AS gain,
  CASE WHEN n >= 14 THEN list_reduce(ld, lambda a, x: (13 * a + x) / 14) END AS loss,
  CASE WHEN n >= 14 THEN list_reduce(list_concat([list_avg(lt[1:14])], lt[15:]), lambda a, x: (13 * a + x) / 14) END AS atr_14 FROM i2),
i4 AS (SELECT *, CASE WHEN n >= 34 THEN list_reduce(list(macd) FILTER (WHERE macd IS NOT NULL) OVER u, lambda a, x: a * 0.8 + x * 0.2) END AS macd_signal,
  CASE WHEN n >= 20 THEN avg(close) OVER m END AS mid, CASE WHEN n >= 20 THEN stddev_pop(close) OVER m END AS dev, CASE WHEN n >= 20 THEN avg(volume) OVER m END AS sma
  FROM i3 WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
ind AS (SELECT ticker, date, open, high, low, close, volume, n, cnt, pc, tr, CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14, ema_9, ema_21, ema_50, macd, macd_signal,
  macd - macd_signal AS macd_diff, mid + 2 * dev AS bb_upper, mid - 2 * dev AS bb_lower, 4 * dev / nullif(mid, 0) AS bb_width, atr_14, volume / nullif(sma, 0) AS volume_ratio_20d FROM i4)"""

INDEX = """
mi AS (SELECT 'ALL' AS symbol, date, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY date),
mj AS (SELECT *, close / lag(close, 5) OVER w - 1 AS ret_5d, close / lag(close, 20) OVER w - 1 AS ret_20d, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER m END AS ma_20
       FROM mi WINDOW w AS (ORDER BY date), m AS (ORDER BY date ROWS 19 PRECEDING)),
trend AS (SELECT *, (ma_20 - lag(ma_20, 5) OVER w) / (lag(ma_20, 5) OVER w + 1e-8) AS slope_20d FROM mj WINDOW w AS (ORDER BY date))"""

CONTEXT = """
c0 AS (SELECT *, ((close - low) - (high - close)) / (high - low + 1e-8) * volume AS flow, row_number() OVER w AS rn, lag(close, 5) OVER w AS c5 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
c1 AS (SELECT ticker, date, close, close / c5 - 1 AS ret_5d, CASE WHEN rn >= 5 THEN avg(close * volume) OVER m END AS turnover_5d, CASE WHEN rn >= 5 THEN sum(flow) OVER m / (sum(volume) OVER m + 1e-8) END AS vol_accum_5d
       FROM c0 WINDOW m AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)),
c2 AS (SELECT c1.*, c1.ret_5d - t.ret_5d AS rel_strength_5d FROM c1 LEFT JOIN trend t USING (date)),
ctx AS (SELECT *, 100 * (rank() OVER (PARTITION BY date ORDER BY rel_strength_5d NULLS LAST) + (count(*) OVER (PARTITION BY date, rel_strength_5d) - 1) / 2.0::DOUBLE) / count(rel_strength_5d) OVER (PARTITION BY date) AS rel_strength_5d_rank,
  100 * (rank() OVER (PARTITION BY date ORDER BY vol_accum_5d NULLS LAST) + (count(*) OVER (PARTITION BY date, vol_accum_5d) - 1) / 2.0::DOUBLE) / count(vol_accum_5d) OVER (PARTITION BY date) AS vol_accum_5d_rank FROM c2
  QUALIFY rel_strength_5d IS NOT NULL AND vol_accum_5d IS NOT NULL)"""

FOLDS = """
fd AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM bars)),
folds AS (SELECT date, CAST(least((pos - 61) // ((nd - 60) // 5) + 1, 5) AS INTEGER) AS fold FROM fd WHERE pos > 60),
franges AS (SELECT fold, min(date) AS fold_start, max(date) AS fold_end FROM folds GROUP BY fold)"""

POINTS = """
p0 AS (SELECT *, lag(rsi_14) OVER w AS rsi1, lag(macd_diff) OVER w AS d1, lag(macd_diff, 2) OVER w AS d2, lag(open) OVER w AS po,
  max(CASE WHEN macd_diff IS NULL OR macd_diff <= 0 THEN n END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS crossed,
  count(bb_width) OVER f AS nw, quantile_cont(bb_width, 0.2) OVER f AS q20, max(high) OVER b20 AS top, min(low) OVER b20 AS bot, max(high) OVER b50 AS far
  FROM ind WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING),
  b20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b50 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
p1 AS (SELECT *, n - coalesce(crossed, 0) - 1 AS days, (macd_diff - d1 > d1 - d2) AND (macd_diff - d1 > 0) AS faster, coalesce(nw >= 10 AND bb_width < q20, false) AS tight,
  (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS pos, (top - close) / close AS toup, (close - bot) / close AS todown, abs(close - open) AS body,
  CASE WHEN high - low > 0 THEN high - low ELSE 1.0 END AS span FROM p0),
p2 AS (SELECT *,
  CASE WHEN ema_50 IS NULL THEN 0 WHEN ema_9 > ema_21 AND ema_21 > ema_50 THEN 20 WHEN ema_9 > ema_21 AND ema_21 < ema_50 THEN 10 WHEN ema_9 < ema_21 AND ema_21 < ema_50 THEN 0 ELSE 2 END AS score_ema,
  CASE WHEN volume_ratio_20d IS NULL THEN 0 WHEN volume_ratio_20d >= 2 THEN 20 WHEN volume_ratio_20d >= 1.5 THEN CAST(trunc(10 + 10 * (volume_ratio_20d - 1.5) / 0.5) AS INTEGER) WHEN volume_ratio_20d >= 1 THEN 2 ELSE 0 END AS score_volume,
  CASE WHEN rsi_14 IS NULL OR rsi1 IS NULL THEN 0 WHEN rsi_14 >= 75 THEN 0 WHEN rsi1 <= 35 AND rsi_14 > rsi1 THEN 15 WHEN rsi_14 >= 50 AND rsi_14 > rsi1 THEN 9 WHEN rsi_14 >= 50 THEN 4 ELSE 0 END AS score_rsi,
  CASE WHEN d2 IS NULL OR macd_diff <= 0 THEN 0 WHEN days <= 3 AND faster THEN 15 WHEN days <= 3 THEN 10 WHEN faster THEN 9 ELSE 3 END AS score_macd,
  CASE WHEN n < 20 THEN 0 WHEN close > top AND close > far THEN 15 WHEN close > top THEN 12 WHEN toup <= 0.02 THEN 6 WHEN close > pc AND todown <= 0.03 THEN 9 WHEN todown <= 0.05 THEN 4 ELSE 1 END AS score_sr,
  CASE WHEN bb_width IS NULL THEN 0 WHEN close < bb_lower AND tight THEN 10 WHEN close < bb_lower THEN 8 WHEN tight THEN 6 WHEN pos < 0.3 THEN 4 WHEN pos < 0.5 THEN 2 WHEN close > bb_upper THEN 0 ELSE 1 END AS score_bollinger,
  CASE WHEN n < 2 THEN 0 WHEN close > open AND pc < po AND open < pc AND close > po THEN 5 WHEN body > 0 AND least(open, close) - low >= 2 * body AND high - greatest(open, close) <= 0.3 * body AND close >= open THEN 4 WHEN body / span < 0.1 THEN 1 ELSE 0 END AS score_candle FROM p1),
pts AS (SELECT *, score_ema + score_volume + score_rsi + score_macd + score_sr + score_bollinger + score_candle AS score FROM p2),
scored AS (SELECT *, CASE WHEN score >= 65 THEN 'BULLISH' WHEN score <= 35 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM pts)"""

ORDER_TAGS = "VOLUME_SPIKE TREND_ALIGNMENT_UP TREND_ALIGNMENT_DOWN RESISTANCE_BREAKOUT SUPPORT_BREAKDOWN HIGH_RSI_RELATIVE LOW_RSI_RELATIVE BB_SQUEEZE MACD_BULLISH_CROSS MACD_BEARISH_CROSS EMA50_FAR_ABOVE EMA50_FAR_BELOW ATR_EXPANSION GAP_UP GAP_DOWN".split()


def below(c: str) -> str:
    held = f"list({c}) FILTER (WHERE {c} IS NOT NULL) OVER h"
    return f"CASE WHEN {c} IS NOT NULL AND len({held}) > 10 THEN 100.0 * len(list_filter({held}, lambda v: v < {c})) / len({held}) END"


TAGS = f"""
t0 AS (SELECT *, {below('volume_ratio_20d')} AS pv, {below('rsi_14')} AS pr, {below('bb_width')} AS pw, max(high) OVER b AS top, min(low) OVER b AS bot, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
  CASE WHEN count(atr_14) OVER a >= 20 THEN avg(atr_14) OVER a END AS atrs, CASE WHEN count(close * volume) OVER v5 >= 3 THEN avg(close * volume) OVER v5 END AS turnover_5d,
  lag(macd) OVER w AS m1, lag(macd, 2) OVER w AS m2, lag(macd, 3) OVER w AS m3, lag(macd_signal) OVER w AS s1, lag(macd_signal, 2) OVER w AS s2, lag(macd_signal, 3) OVER w AS s3
  FROM ind WINDOW w AS (PARTITION BY ticker ORDER BY date), h AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  a AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), v5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)),
t1 AS (SELECT *, CASE WHEN m1 <= s1 AND macd > macd_signal THEN 1 WHEN m1 >= s1 AND macd < macd_signal THEN -1 WHEN m2 <= s2 AND macd > macd_signal THEN 2 WHEN m2 >= s2 AND macd < macd_signal THEN -2
  WHEN m3 <= s3 AND macd > macd_signal THEN 3 WHEN m3 >= s3 AND macd < macd_signal THEN -3 END AS cross_at, (close - ema_50) / nullif(ema_50, 0) * 100 AS far, atr_14 / nullif(atrs, 0) AS ratio,
  (open - ph) / nullif(ph, 0) * 100 AS gup, (open - pl) / nullif(pl, 0) * 100 AS gdn FROM t0),
t2 AS (SELECT *, CASE WHEN pv >= 90 THEN volume_ratio_20d END AS volume_spike, CASE WHEN ema_9 > ema_21 AND ema_21 > ema_50 THEN 1.0 END AS trend_alignment_up, CASE WHEN ema_9 < ema_21 AND ema_21 < ema_50 THEN 1.0 END AS trend_alignment_down,
  CASE WHEN close > top THEN top END AS resistance_breakout, CASE WHEN NOT coalesce(close > top, false) AND close < bot THEN bot END AS support_breakdown, CASE WHEN pr >= 90 THEN rsi_14 END AS high_rsi_relative, CASE WHEN pr <= 10 THEN rsi_14 END AS low_rsi_relative,
  CASE WHEN pw <= 10 THEN pw END AS bb_squeeze, CASE WHEN cross_at > 0 THEN cross_at END AS macd_bullish_cross, CASE WHEN cross_at < 0 THEN -cross_at END AS macd_bearish_cross, CASE WHEN ema_50 > 0 AND far > 5 THEN far END AS ema50_far_above,
  CASE WHEN ema_50 > 0 AND far < -5 THEN far END AS ema50_far_below, CASE WHEN ratio >= 1.5 THEN ratio END AS atr_expansion, CASE WHEN gup >= 1 THEN gup END AS gap_up, CASE WHEN gdn <= -1 THEN gdn END AS gap_down FROM t1),
tags AS (SELECT *, CASE WHEN n >= 60 THEN list_filter([{', '.join(f"CASE WHEN {t.lower()} IS NOT NULL THEN '{t}' END" for t in ORDER_TAGS)}], lambda x: x IS NOT NULL) ELSE [] END AS all_ids FROM t2),
tagged AS (SELECT *, list_filter(all_ids, lambda x: x NOT LIKE 'TREND_%') AS unusual FROM tags)"""

LATEST = """
latest AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"""

_has = lambda t: f"list_contains(unusual, '{t}')"
OPINION = f"""
o1 AS (SELECT *, CASE WHEN ({_has('RESISTANCE_BREAKOUT')} OR {_has('SUPPORT_BREAKDOWN')} OR {_has('BB_SQUEEZE')}) AND {_has('VOLUME_SPIKE')} THEN 3 ELSE 0 END + CASE WHEN {_has('MACD_BULLISH_CROSS')} OR {_has('MACD_BEARISH_CROSS')} THEN 2 ELSE 0 END AS a1 FROM latest WHERE len(unusual) > 0),
o2 AS (SELECT *, a1 + CASE WHEN {_has('HIGH_RSI_RELATIVE')} AND {_has('EMA50_FAR_ABOVE')} THEN CASE WHEN a1 < 4 THEN 2 ELSE 0 END WHEN {_has('HIGH_RSI_RELATIVE')} OR {_has('LOW_RSI_RELATIVE')} THEN CASE WHEN a1 < 3 THEN 1 ELSE 0 END ELSE 0 END AS a2 FROM o1),
o3 AS (SELECT *, a2 + CASE WHEN ({_has('EMA50_FAR_ABOVE')} OR {_has('EMA50_FAR_BELOW')}) AND a2 < 3 THEN 1 ELSE 0 END AS a3 FROM o2),
o4 AS (SELECT *, a3 + CASE WHEN {_has('ATR_EXPANSION')} AND a3 < 3 THEN 2 ELSE 0 END AS a4 FROM o3),
o5 AS (SELECT *, a4 + CASE WHEN ({_has('GAP_UP')} OR {_has('GAP_DOWN')}) AND a4 < 2 THEN 1 ELSE 0 END AS attention FROM o4),
scan AS (SELECT *, CASE WHEN attention >= 5 THEN 'HIGH' WHEN attention >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM o5 ORDER BY len(unusual) DESC, ticker LIMIT 15)"""


def returns(source: str, out: str = "fwd", limit: str = "") -> str:
    """source with n, fold and fold_end: returns by horizon, exits at most ten days after the fold."""
    h = ", ".join(f"CASE WHEN lead(date, {k}) OVER w <= fold_end + 10 THEN lead(close, {k}) OVER w / close - 1 END AS return_n{k}" for k in (1, 3, 5))
    return f"""
{out}0 AS (SELECT s.*, f.fold, r.fold_end FROM {source} s LEFT JOIN folds f USING (date) LEFT JOIN franges r USING (fold)),
{out} AS (SELECT *, {h} FROM {out}0 WINDOW w AS (PARTITION BY ticker ORDER BY date) QUALIFY row_number() OVER w >= 60 AND fold IS NOT NULL)"""


SIGNALS = f"{returns('scored')},\nsig AS (SELECT * FROM fwd WHERE score >= 65)"

METRICS = """
perfold AS (SELECT fold, count(return_n3) AS n, CASE WHEN count(return_n3) >= 5 THEN avg(CASE WHEN return_n3 IS NOT NULL THEN CAST(return_n3 >= 0.024 AS INTEGER) END) END AS win_rate,
  avg(CASE WHEN return_n3 >= 0 THEN return_n3 END) AS avg_win, avg(CASE WHEN return_n3 < 0 THEN return_n3 END) AS avg_loss, CASE WHEN count(return_n3) >= 10 THEN avg(return_n3) - 0.004 END AS expected_value, min(return_n3) AS worst FROM sig GROUP BY fold)"""

EVENTS = """
act AS (SELECT p_brand AS ticker, CAST(o_orderdate AS DATE) AS date, 'DIVIDEND' AS event_type, 100 * max(l_discount) AS dividend_yield
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND o_orderpriority = '1-URGENT' GROUP BY 1, 2)"""


def counted(sql: str) -> str:
    """count_if and sums of counts as BIGINT, the type that Spark gives them."""
    out, at = "", 0
    for name in iter(lambda: sql.find("count_if(", at), -1):
        depth, end = 1, name + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:name] + f"CAST({sql[name:end]} AS BIGINT)"
        at = end
    return out + sql[at:]


def query(select: str, *blocks: str) -> str:
    return counted("WITH " + ",".join(blocks) + "\n" + select)
