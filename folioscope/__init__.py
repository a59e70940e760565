"""folioscope: grounded document retrieval analytics as DataFrame programs."""

__version__ = "0.1.0"
