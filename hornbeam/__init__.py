"""hornbeam: rule reasoning over knowledge graphs, and corpus preparation, as Spark plans."""
