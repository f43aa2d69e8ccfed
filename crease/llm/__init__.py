"""Operators on names, free text and documents. Nothing outside this folder imports it."""
