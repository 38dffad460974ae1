"""DataFrame transformations over ledgers and players."""
