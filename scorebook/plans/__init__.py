"""Registered queries over the shared tables, each with the SQL that checks it."""
