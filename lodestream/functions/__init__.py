"""Part of lodestream."""
