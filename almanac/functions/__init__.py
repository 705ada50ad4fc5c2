"""Column functions: each takes and returns Columns, so they stay inside the JVM's generated code."""
