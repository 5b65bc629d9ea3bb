"""Column expressions: text analysis and vector arithmetic."""
