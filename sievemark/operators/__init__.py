"""Checks, scoring, repair, drift, rules and the model benchmark."""
