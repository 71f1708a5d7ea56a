"""Column expressions: no shuffle, no Python workers, usable on streams too."""
