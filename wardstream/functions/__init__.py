"""Scalar expressions and vocabularies."""
