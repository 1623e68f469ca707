"""Readers for tables and exports."""
