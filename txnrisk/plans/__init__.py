"""Composed jobs: scoring, training, analytics, and the registered queries."""
