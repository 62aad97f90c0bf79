"""Column functions: text, addresses, dates, places, rule values."""
