"""Registered queries: thin compositions of the operators over the tables of one directory."""
