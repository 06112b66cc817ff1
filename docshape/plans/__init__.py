"""From SQL text and schemas to plans."""
