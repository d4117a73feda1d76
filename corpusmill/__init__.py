"""Document analytics on Spark: load, split, embed, filter, search, summarise."""
