"""The same analytics on a stream of ledger entries."""
