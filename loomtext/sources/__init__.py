"""Readers and writers of corpora, dictionaries, features and reports."""
