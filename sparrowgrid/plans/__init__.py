"""The queries of the library by name, and the SQL that states the same result where SQL can."""

from . import more, network, series  # noqa: F401  they register their queries
from .relational import ORACLES, QUERIES
