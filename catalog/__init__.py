"""Registered queries over the test tables, with the SQL that must give the same rows."""
