"""Operators over spots, neighbour edges, sparse expression and factor loadings."""
