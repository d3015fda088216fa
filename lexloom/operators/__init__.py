"""Index, search, fusion, serving, chunking and profiling operators."""
