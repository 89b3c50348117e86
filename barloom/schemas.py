"""Schemas of the stored tables."""

BARS = "ticker string, date date, open double, high double, low double, close double, volume double, is_valid boolean, validation_note string"
INDICATORS = "ticker string, date date, rsi_14 double, ema_9 double, ema_21 double, ema_50 double, macd double, macd_signal double, macd_diff double, bb_upper double, bb_lower double, bb_width double, atr_14 double, volume_ratio_20d double"
CONTEXT = "ticker string, date date, rel_strength_5d double, rel_strength_5d_rank double, vol_accum_5d double, vol_accum_5d_rank double, turnover_5d double"
ACTIONS = "ticker string, date date, event_type string, value double, dividend_yield double"
ANNOUNCEMENTS = "announcement_id string, date date, ticker string, title string, tags string, summary string"
STOCKS = "ticker string, name string, sector string, last_updated timestamp"
INDEX = "symbol string, date date, close double, volume double, ret_5d double, ret_20d double, ma_20 double, slope_20d double"
SIGNALS = "id long, ticker string, date date, skor_total int, sinyal string, breakdown string, scoring_version string"
OUTCOMES = "signal_id long, ticker string, signal_date date, price_at_signal double, target_threshold double"
SCAN_RESULTS = "scan_date date, ticker string, close double, turnover_5d double, unusual_count int, unusual_tags array<string>, all_tags array<struct<tag_id:string,value:double,is_unusual:boolean>>, liquidity_note string, breadth_context string, sector_context string"
TABLES = {"bars": BARS, "indicators": INDICATORS, "context": CONTEXT, "actions": ACTIONS, "announcements": ANNOUNCEMENTS, "stocks": STOCKS, "index": INDEX, "signals": SIGNALS, "outcomes": OUTCOMES, "scan_results": SCAN_RESULTS}
