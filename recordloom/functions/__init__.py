"""functions of the record engine, all DataFrame in, DataFrame out."""
