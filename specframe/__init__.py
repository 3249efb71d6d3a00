"""Software-inventory analytics over fleets of code bases, as Spark jobs."""

__version__ = "0.1.0"
