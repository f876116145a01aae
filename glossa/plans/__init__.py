"""The registered queries and their SQL: importing the package registers those of every module."""

from . import encoded, oracles, queries, segmented  # noqa: F401
