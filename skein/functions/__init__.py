"""Part of skein; see the README for what lies where."""
