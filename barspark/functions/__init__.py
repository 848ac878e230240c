"""Column functions: calendar, measures, identifiers."""
