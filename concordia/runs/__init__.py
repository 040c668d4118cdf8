"""Whole runs: comparing packages with a document, and filling the missing descriptions."""
