"""Operators: DataFrame -> DataFrame functions and small-state learners."""
