"""A usage-ledger analytics engine expressed as PySpark DataFrame plans."""
