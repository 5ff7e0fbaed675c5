"""Operators of a training-data pipeline. Nothing else in packetlake imports this subpackage."""
