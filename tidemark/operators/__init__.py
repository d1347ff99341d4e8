"""Operators on panels: functions from DataFrames to lazy DataFrames."""
