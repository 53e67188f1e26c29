"""Stochastic generators: fit(flow) gives a model of small tables, generate() an ensemble table."""
