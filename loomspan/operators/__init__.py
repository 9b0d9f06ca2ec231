"""Operators on DataFrames, and text algorithms that run as Arrow functions on the executors."""
