"""Part of codescout; see README.md."""
