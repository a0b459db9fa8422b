"""Training-data operators on Spark: search, de-duplication, language, sharding, packing, mixing and token files."""
