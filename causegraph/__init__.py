"""causegraph: a Spark-native engine for health knowledge graphs and interview transcripts."""
