"""Registered queries of the engine, one module for each stage of analysis."""

from . import analysis, bandcodes, coarse, coding, containers, curves, filterbank, floors, hearing, layout, lowdelay, masks, perception, planning, quality, rate, regions, spectra, streams, telemetry
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "pcm_quality"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "analysis", "bandcodes", "coarse", "coding", "containers", "curves", "filterbank", "floors", "hearing", "layout", "lowdelay", "masks", "perception", "planning", "quality", "rate", "regions", "spectra", "streams", "telemetry"]
