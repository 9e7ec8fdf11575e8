"""Distributed operators built from DataFrame joins, windows and grouped aggregates."""
