"""Column expressions: text cleaning, label and answer parsing, diff handling, statistics."""
