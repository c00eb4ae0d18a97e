"""Spark jobs for spatial factor models, their analysis operators, and text-corpus preparation."""
