"""Streams over a landing directory (an extension; batch operators do the work)."""
