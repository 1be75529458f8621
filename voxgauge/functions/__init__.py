"""Column functions: text errors, label parsing, verdicts, naming and numeric helpers."""
