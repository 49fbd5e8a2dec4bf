"""Readers and writers of keyed text tables and binary archives."""
