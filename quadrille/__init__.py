"""quadrille: a Spark-native engine for graph fragments, statistics and text renderings of nodes."""
