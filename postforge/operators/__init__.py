"""Set-level operators over the domain's tables."""
