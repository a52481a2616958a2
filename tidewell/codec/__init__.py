"""Byte kernels: what a task runs on one block.  Plain Python and numpy, no Spark."""
