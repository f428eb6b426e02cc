"""DataFrame operators: classification, ranking, redaction, splitting, retrieval, graphs, budgets, impact."""
