"""Readers and the views of the test tables as presence data."""
