"""Training-data operators: quality, copies, mixing, sharding and tokens of a text corpus."""
