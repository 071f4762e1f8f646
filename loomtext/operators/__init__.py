"""Relational operators over tokens, nodes and labels."""
