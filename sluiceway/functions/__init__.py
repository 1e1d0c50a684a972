"""Column-level helpers: everything here maps Column -> Column."""
