"""Inputs: star-schema tables (Parquet) and their derivation from TPC-H-like tables."""

from shelfwise.sources.staging import Stage
from shelfwise.sources.star import GRAIN, Star, read_star, stage_star, validate, write_star
from shelfwise.sources.tpch import derive_star, load_star, release_stars

__all__ = ["GRAIN", "Stage", "Star", "derive_star", "load_star", "read_star", "release_stars", "stage_star", "validate", "write_star"]
