"""Temporal-event analytics on PySpark: intervals, fusion, matching and metrics as DataFrame operators."""
