"""Named compositions: feature recipes, model protocols, stacking."""
