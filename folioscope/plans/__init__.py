"""Part of the folioscope engine."""
