"""Scalar functions: expressions over Spark columns where semantics differ from Spark's own."""
