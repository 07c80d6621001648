"""Column expressions: labels, predicates, text, fingerprints and vectors."""
