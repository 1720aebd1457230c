"""The layered model: staging, silver, gold, mart, and the registry that orders them."""
