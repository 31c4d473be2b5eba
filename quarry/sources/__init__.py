"""Readers and writers of the toolkit's text formats."""
