"""Training-data operators on documents and embeddings.

Nothing outside this package imports it. Every operator takes and returns lazy DataFrames; where an
operator writes an intermediate table it goes to the folder named by ``spark.checkpoint.dir``.
"""
