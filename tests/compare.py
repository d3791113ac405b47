"""Order-insensitive result comparison with float tolerance (shared by tests and tools)."""

import math

import pandas as pd


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        return ("~null",) if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime().replace(tzinfo=None))
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _num(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _key(rec):
    return (tuple(repr(x) for x in rec if not _num(x)), tuple(f"{float(x):.9g}" for x in rec if _num(x)))


def _same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, (float, int)) and not isinstance(b, bool):
        return math.isclose(a, float(b), rel_tol=1e-6, abs_tol=1e-9)
    if isinstance(b, float) and isinstance(a, int) and not isinstance(a, bool):
        return math.isclose(float(a), b, rel_tol=1e-6, abs_tol=1e-9)
    return a == b


def frames_equal(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else a short reason."""
    lc, rc = sorted(left.columns), sorted(right.columns)
    if lc != rc:
        return f"columns {lc} != {rc}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a = sorted((tuple(_norm(x) for x in r) for r in left[lc].itertuples(index=False, name=None)), key=_key)
    b = sorted((tuple(_norm(x) for x in r) for r in right[lc].itertuples(index=False, name=None)), key=_key)
    for x, y in zip(a, b):
        if not _same(x, y):
            return f"first difference {x} vs {y}"
    return None
