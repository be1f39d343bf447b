"""wordtide: word metrics over large collections of short, noisy text, on Spark."""

__version__ = "0.1.0"
