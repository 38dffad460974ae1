"""pointline: points-ledger analytics as Spark DataFrame transformations."""
