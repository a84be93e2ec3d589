"""Catalog analytics for large media-style collections, written as Spark logical plans."""
