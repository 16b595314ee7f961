"""Subpackage; see the modules."""
