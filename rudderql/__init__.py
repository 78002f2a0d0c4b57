"""Query steering, workload analytics and relational templates on Spark."""
