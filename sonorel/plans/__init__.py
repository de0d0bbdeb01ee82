"""Registered queries over the test tables, each with its SQL oracle where SQL can express it."""
