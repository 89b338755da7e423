"""Reading and writing recordings, tracks and caches."""
