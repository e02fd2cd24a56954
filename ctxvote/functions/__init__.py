"""Column functions: tokens, normalisation, context windows, names, types."""
