"""Operators over snapshot facts. Every function is lazy: DataFrame in, DataFrame out."""
