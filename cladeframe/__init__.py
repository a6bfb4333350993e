"""Phylogenomic analytics as PySpark DataFrame operators."""
