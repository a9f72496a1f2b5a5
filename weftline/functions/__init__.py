"""Column expressions. Each takes columns (or names) and returns a Column; all but two run in the JVM."""
