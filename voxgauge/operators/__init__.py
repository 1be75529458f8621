"""Relational operators: matching, lookups, roll-ups, exact ranks, signals, windows, logs."""
