"""Analytics over dated text sequences, and text-corpus preparation, as Spark jobs."""
