"""Readers, snapshot tables and exchange formats."""
