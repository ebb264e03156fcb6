"""Set-at-a-time decision engine on PySpark."""

__version__ = "0.1.0"
