"""One module for each query: NAME, query(spark, sf_dir), and SQL where there is any."""
