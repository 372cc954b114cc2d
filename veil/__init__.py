"""veil: finding, masking, restoring and auditing sensitive data with Spark."""

from veil.config import Config
from veil.lexicons import Lexicons

__all__ = ["Config", "Lexicons"]
