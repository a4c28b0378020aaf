"""Readers of bibliographic exports and of the analytic views."""
