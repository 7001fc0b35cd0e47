"""Operators: DataFrame -> DataFrame transforms."""
