"""Operators of the search engine as DataFrame transformations."""
