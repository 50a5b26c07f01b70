"""Column expressions: scalars (J), text cleaning (F, G1, G9), prompts (H)."""
