"""Column functions: money, time, risk, text, vectors."""
