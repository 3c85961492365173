"""Column functions: built from Spark expressions, so they stay in generated code."""
