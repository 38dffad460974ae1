"""Tables in and out: ledger readers, ingest checks, table upkeep and sinks."""
