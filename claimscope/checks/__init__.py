"""Stand-in tables over the test data, and the registry of queries and their SQL."""
