"""edgewright: dependency-graph analytics and bulk record processing on plain Spark DataFrames."""
