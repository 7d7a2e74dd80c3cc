"""Column functions: text, units, identities; and the fixed dimension tables."""
