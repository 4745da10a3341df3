"""Named queries over the driver's tables (``catalog``) and their DuckDB
oracle SQL (``oracles``)."""
