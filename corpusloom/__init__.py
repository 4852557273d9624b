"""corpusloom: Spark-native cleaning and preparation of text corpora."""
