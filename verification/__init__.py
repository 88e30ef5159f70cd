"""Inputs, queries and expected results for the driver's check and the tests."""
