"""A columnar analytics engine on Spark with workload-driven range partitioning."""
