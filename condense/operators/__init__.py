"""DataFrame operators, each a function of tables to a table."""
