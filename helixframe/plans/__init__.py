"""Join and checkpoint strategies that several operators share."""
