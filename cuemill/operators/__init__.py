"""Table jobs over segments, videos and queues: DataFrame in, DataFrame out."""
