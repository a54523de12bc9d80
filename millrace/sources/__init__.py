"""Readers and writers of the exchange's formats."""
