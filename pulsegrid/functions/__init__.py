"""Column expressions: cleaning, calendar, classification, text and coordinates."""
