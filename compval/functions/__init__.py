"""Column builders: parsers, categories, dissimilarities, costs, error measures."""
