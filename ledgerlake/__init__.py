"""Portfolio analytics on Spark: ledgers, holdings, valuation, gaps and corporate actions as DataFrame operators."""
