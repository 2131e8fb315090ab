"""Readers and writers for the file layouts the operators consume and produce."""
