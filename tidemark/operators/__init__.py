"""Relational operators: index construction, retrieval, ranking, fusion, multi-value fields."""
