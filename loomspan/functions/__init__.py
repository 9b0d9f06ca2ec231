"""Scalar functions: Spark columns in, Spark columns out."""
