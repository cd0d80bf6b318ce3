"""Views over the test tables, the registered queries and their SQL."""
