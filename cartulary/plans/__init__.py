"""The query catalogue: adapters over ordinary tables, queries, and SQL with the same rows."""
