"""Composed jobs: harvest, clean, analyse."""
