"""Puts the repository's top on the path of the tests."""
