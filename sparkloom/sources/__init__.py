"""Readers: each gives a DataFrame of facts from files that all executors can read."""
