"""Queries over the tables of the test data, each with the SQL it must agree with where SQL can say it."""
