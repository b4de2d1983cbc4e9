"""The stateless parts on streams."""
