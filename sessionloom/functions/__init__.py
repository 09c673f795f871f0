"""Column functions: text, reducers, scores and budgets."""
