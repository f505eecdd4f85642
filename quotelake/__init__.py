"""Market-evidence operators for PySpark: quotes, bars, rules, ledgers, evidence."""
