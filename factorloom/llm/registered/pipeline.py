import corpus_pipeline

NAME, SQL = "pipeline", corpus_pipeline.ORACLE_SQL
query = corpus_pipeline.run
