"""plans of smogcast."""
