"""Operators that prepare text corpora. Nothing else in the package imports this one."""
