"""Statistical operators: DataFrame in, tidy DataFrame out."""
