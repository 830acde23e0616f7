"""Operators over sources, pages, passages, vectors, answers and evaluations."""
