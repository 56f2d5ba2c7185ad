"""Ledger operators: functions from DataFrames to DataFrames, for all tenants at once."""
