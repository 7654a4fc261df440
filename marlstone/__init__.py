"""Listing-market analytics on Spark: a lake, a geo matcher, gold tables, streams and models."""
