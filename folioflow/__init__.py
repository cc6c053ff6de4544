"""Spark operators that turn loosely structured business files into queryable data, and queries over them."""
