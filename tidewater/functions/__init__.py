"""Column to Column: text, money, phones, dates, vectors, rules."""
