"""Tiled map archives, version 3: a Python data source for reading, and a writer."""

from .source import TileArchive, read_batch, register
from .writer import assemble, write

__all__ = ["TileArchive", "assemble", "read_batch", "register", "write"]
