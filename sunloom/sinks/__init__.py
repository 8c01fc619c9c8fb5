"""Sinks: result tables, reports and parameters as files."""
