"""Column expressions: header parsing, keys, verdicts and outcome classes."""
