"""SQL equivalents of the registered queries, and the query registry."""
