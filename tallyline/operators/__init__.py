"""Relational operators over ledger DataFrames."""
