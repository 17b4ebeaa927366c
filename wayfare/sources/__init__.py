"""Typed readers, writers and the test-data views."""
