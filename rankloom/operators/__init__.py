"""Relational operators: lazy DataFrame to DataFrame functions."""
