"""Market research on Spark: bars, indicators, observations, scores, backtests and event studies as DataFrame plans."""
