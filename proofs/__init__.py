"""The library's operators and reports on the test tables, each with a SQL counterpart."""
