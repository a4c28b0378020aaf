"""Operators: functions from DataFrames to DataFrames, without hidden state."""
