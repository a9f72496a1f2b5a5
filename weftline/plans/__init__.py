"""Built tables, the matrix and the registered queries."""
