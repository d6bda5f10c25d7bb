"""Evidence-linkage analytics on Spark SQL."""
