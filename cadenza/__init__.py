"""Audio-signal analytics on Spark: streams, frames, spectra and coding candidates as tables."""
