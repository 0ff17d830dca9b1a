"""Inputs and outputs: JSON lines, tab lists, media and archives inside media."""
