"""Whole questions, composed from the operators."""
