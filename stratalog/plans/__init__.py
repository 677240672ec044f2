"""The store and the queries over it."""
