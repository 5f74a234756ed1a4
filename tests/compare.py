from __future__ import annotations


def same(a, b) -> bool:
    """Two pandas frames as multisets of rows, columns by name."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns) or len(a) != len(b):
        return False
    x, y = (f[cols].astype(str).sort_values(cols).reset_index(drop=True) for f in (a, b))
    return x.equals(y)
