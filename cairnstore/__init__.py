"""A content-addressed, transactional blob store and its queries on PySpark."""
