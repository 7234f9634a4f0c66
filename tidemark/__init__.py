"""Market-signal analytics on Spark: bars, signals, ensembles, evaluation and document feeds."""
