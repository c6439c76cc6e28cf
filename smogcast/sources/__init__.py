"""sources of smogcast."""
