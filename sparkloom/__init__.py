"""A Spark-first analytics library: relational operators, joins, rollups, merges and plan reports on DataFrames."""
