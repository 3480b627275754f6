"""Readers, writers and the mapping of raw tables to the domain model."""
