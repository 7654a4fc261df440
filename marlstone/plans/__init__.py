"""Registered queries: each module maps names to functions of (spark, sf_dir) and to SQL."""
