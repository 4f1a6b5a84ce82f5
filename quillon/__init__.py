"""Part of quillon, a Spark-first document-relational analytics engine."""
