"""Whole runs: from a file of records to tables and reports."""
