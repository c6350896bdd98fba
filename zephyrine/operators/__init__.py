"""Relational operators that Spark lacks, or whose semantics differ."""
