"""Multi-tenant personal-ledger analytics, written as PySpark DataFrame functions."""
