"""Column -> Column functions: text keys, numbers, dates, identifiers."""
