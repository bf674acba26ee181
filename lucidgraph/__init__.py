"""Graph layout and layout readability on Spark DataFrames.

A graph is two DataFrames (``edges``: src, dst; ``vertices``: id) and a layout
is one (``trial, id, x, y``).  Every operator takes ``by``, the columns that
tell layouts apart, so any number of candidate layouts share one job.
"""

__version__ = "0.1.0"
