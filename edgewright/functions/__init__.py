"""Part of edgewright."""
