"""Part of kbspark."""
