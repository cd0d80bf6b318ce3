"""Column expressions: text, scripts, keys, clocks."""
