"""Sources and sinks: adaptors of tables, WAV and FLAC files, containers."""
