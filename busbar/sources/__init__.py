"""Readers, writers and the bindings from the driver's tables to grid data."""
