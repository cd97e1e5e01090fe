"""DuckDB SQL that checks the registered queries."""

from oracles import checks, diagnosis, marts, metrics  # noqa: F401
from oracles.common import ORACLES

__all__ = ["ORACLES"]
