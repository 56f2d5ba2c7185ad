"""Composed plans: the dashboard and the catalogue of registered queries."""
