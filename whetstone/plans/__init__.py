"""Registered queries and the SQL each one equals."""
