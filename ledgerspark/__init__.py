"""Golden-ledger data processing on Spark: generation, reconciliation, gates, export and evaluation."""
