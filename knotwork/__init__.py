"""knotwork: knowledge-graph analytics as plain Spark DataFrame jobs."""
