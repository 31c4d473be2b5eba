"""Operators over tables: indexing, search, scoring, expansion, graphs, evaluation, learning."""
