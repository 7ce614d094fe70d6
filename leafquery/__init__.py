"""leafquery: ask SQL-like questions of whole collections of web pages, planned as Spark DataFrames."""

__version__ = "0.1.0"
