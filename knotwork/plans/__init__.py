"""The graph of the driver tables, the queries over it, and their SQL."""
