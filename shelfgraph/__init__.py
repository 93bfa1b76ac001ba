"""shelfgraph: a Spark-native engine for catalogue graphs, text analytics and corpus building."""

__version__ = "0.1.0"
