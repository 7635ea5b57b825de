"""Readers of the catalog, tree, chat and text tables."""
