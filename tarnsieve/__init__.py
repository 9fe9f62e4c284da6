"""A content-deduplication and retention-policy engine on PySpark."""
