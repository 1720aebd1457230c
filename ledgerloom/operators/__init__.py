"""Operators that a plain relational plan does not have: merges, histories, diffs, orphan cascades, parsing."""
