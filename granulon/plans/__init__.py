"""The queries: operators applied to the test tables, each with the SQL that gives the same rows."""
