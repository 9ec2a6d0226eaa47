"""Training-data operators: sharding, filtering, tokenising, packing, de-duplication,
scoring, chat formatting and page extraction. Nothing else in the package imports this."""
