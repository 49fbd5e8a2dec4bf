"""Operators: DataFrame in, DataFrame out. Random choices depend on a hash of the key and a seed."""
