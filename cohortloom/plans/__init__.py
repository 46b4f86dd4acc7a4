"""The whole study as one composition of operators."""
