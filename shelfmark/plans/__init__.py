"""The registered queries and the tables they stand on."""
