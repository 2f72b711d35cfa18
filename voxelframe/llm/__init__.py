"""Training-data operators: tokenising, mixing, similarity joins, classifiers, extraction, rules, formatting, search."""
