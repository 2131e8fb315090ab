"""Column builders; every function returns a lazily evaluated Column."""
