"""Operators on frame sequences: DataFrames of clips' frames in order."""
