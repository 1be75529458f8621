"""Composed jobs: one verdict table per task, their roll-ups, the dataset audit, readiness and run reports."""
