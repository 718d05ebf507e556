"""quirespark: document analytics and page-structure operators on PySpark."""

__version__ = "0.1.0"
