"""Operators over facts and sets of person ids."""
