"""Publication monitoring on Spark: sources, functions, operators, report tables and streaming twins."""
