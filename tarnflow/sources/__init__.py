"""Reading and writing flows and ensembles."""
