"""DuckDB oracle SQL for the driver's correctness gate (see ``__spark_entry__``)."""
