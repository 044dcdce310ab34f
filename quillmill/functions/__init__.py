"""Part of quillmill; see the README for the map of modules."""
