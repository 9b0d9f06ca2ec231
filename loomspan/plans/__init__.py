"""Registered queries, their SQL, and plans made of several operators."""
