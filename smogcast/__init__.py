"""smogcast: city air-quality analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames (or Columns) and is lazy; the
work runs on Spark when the caller acts on the result.
"""

__version__ = "0.1.0"
