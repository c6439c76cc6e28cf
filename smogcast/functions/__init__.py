"""functions of smogcast."""
