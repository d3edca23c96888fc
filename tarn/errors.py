"""What is wrong with a query."""


class QueryError(ValueError):
    """The query can't be run as it is written."""
