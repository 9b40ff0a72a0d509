"""Column expressions: presence, parsing, text forms and conditions."""
