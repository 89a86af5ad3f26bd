"""Category market analytics on Spark: catalog + reviews in, one report per category out."""
