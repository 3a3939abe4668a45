"""Set-based operators over panels of dated levels and returns."""
