"""streaming of smogcast."""
