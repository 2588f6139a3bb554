"""The registered queries and the SQL that states the same results."""
