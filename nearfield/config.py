"""Parameters of a collection and of its index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexConfig:
    """Shape of the navigable graph. Layer 0 keeps up to ``m_max0`` neighbours, other layers ``m``."""

    dim: int = 128
    m: int = 16
    m_max0: int = 32
    ef_construction: int = 200
    ef_search: int = 50
    max_layers: int = 6

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("dim must be positive")
        if self.m < 2:
            raise ValueError("m must be at least 2")
        if self.ef_construction < 1 or self.max_layers < 1:
            raise ValueError("ef_construction and max_layers must be at least 1")


@dataclass(frozen=True)
class CollectionConfig:
    """A collection: its index, its shards, and the points each shard has on the hash ring."""

    index: IndexConfig = IndexConfig()
    shards: int = 3
    vnodes: int = 150
    checkpoint_every: int = 1000
    top_k: int = 5
    most_top_k: int = 1000

    def __post_init__(self) -> None:
        if self.shards <= 0 or self.vnodes <= 0:
            raise ValueError("shards and vnodes must be positive")


def live_top_k(k: int | None, default: int = 5, most: int = 1000) -> int:
    """The lenient policy: what is missing, not positive or too large becomes the default."""
    return default if k is None or k <= 0 or k > most else k


def strict_top_k(k: int) -> int:
    if k <= 0:
        raise ValueError("top_k must be positive")
    return k


def search_width(ef: int | None, default: int, k: int) -> int:
    """Width of the beam: the default where none is given, and never less than k."""
    return max(ef if ef and ef > 0 else default, k)
