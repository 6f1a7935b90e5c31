"""Expression text to plans, and the catalogue of queries."""
