"""Column expressions: grid predicates, geometry helpers and id-array helpers."""
