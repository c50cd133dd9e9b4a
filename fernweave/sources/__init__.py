"""Where graphs, files and snapshots come from, and where they go."""
