"""Part of quiverlake; see the README for the map."""
