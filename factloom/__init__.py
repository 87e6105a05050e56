"""factloom: evidence-backed analytics on Apache Spark."""
