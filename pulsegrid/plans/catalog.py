"""All registered queries (importing the modules fills the registry)."""

from . import queries_model, queries_signal  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
