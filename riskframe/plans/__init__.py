"""Test-table roles and the registered queries."""
