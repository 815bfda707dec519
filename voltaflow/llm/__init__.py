"""Training-data operators: ten text operators and their registered queries."""
