"""Part of tidegrid."""
