"""Jobs made of several operators, and the queries over the test tables."""
