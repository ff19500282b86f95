"""Detection rules, correlations and alert analytics as Spark DataFrame plans."""
