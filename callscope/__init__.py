"""Part of callscope."""
