"""Registered queries: one per operator, with SQL for the comparison."""
