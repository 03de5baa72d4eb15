"""Analytics over document-derived knowledge graphs, written as Spark plans."""
