"""Set-oriented operators over fleet tables."""
