"""Composed jobs: fixture tables -> cleaned orders -> evaluations."""
