"""DataFrame operators on long-format flows."""
