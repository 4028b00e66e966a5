"""Column functions: text, style sheets, markup and small values."""
