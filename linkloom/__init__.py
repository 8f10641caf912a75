"""Link-graph analytics over captured pages, on Spark."""
