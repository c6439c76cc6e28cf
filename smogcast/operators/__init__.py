"""operators of smogcast."""
