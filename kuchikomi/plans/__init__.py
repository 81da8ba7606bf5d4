"""Whole jobs composed from the operators, input views over the test tables, and the query catalogue."""
