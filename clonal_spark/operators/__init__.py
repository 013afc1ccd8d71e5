"""DataFrame operators: one step of a fit, score or query each."""
