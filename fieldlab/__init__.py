"""fieldlab: realism scores for gridded snapshot data, as PySpark DataFrame operators."""
