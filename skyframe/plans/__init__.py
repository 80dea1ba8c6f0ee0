"""Compositions of operators: the read-side queries and the batch stages."""
