"""gaugeline: quality control for sensor networks as Spark DataFrame operators."""

from gaugeline.config import QCConfig

__all__ = ["QCConfig"]
