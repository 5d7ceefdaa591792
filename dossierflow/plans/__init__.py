"""Whole runs and the tables that follow from them: status, results, spans, views."""
