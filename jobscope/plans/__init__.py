"""Views over the test tables and the registered queries."""
