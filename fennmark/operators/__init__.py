"""Operators: functions of DataFrames and columns."""
