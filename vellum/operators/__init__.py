"""DataFrame operators: retrieval, ranking, maintenance, evaluation, memory, metrics and state."""
