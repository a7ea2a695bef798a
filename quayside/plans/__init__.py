"""Queries over a data folder, their SQL, and the serving functions."""
