"""corpusgrid: Spark-first data work on labelled corpora, many small graphs and predictions."""
