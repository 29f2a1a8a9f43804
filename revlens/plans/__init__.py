"""Plans: stage runner, run metrics, and the registry of named queries
(each a Spark job over the driver tables with its DuckDB oracle)."""
