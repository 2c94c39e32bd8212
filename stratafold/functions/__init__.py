"""Column expressions. Everything here stays in built-in, code-generated Spark functions."""
