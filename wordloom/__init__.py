"""wordloom: typed record tables, id sets and full-text search on PySpark."""
