"""Shared plans: statistics passes, exact quantiles, duplicate counting."""
