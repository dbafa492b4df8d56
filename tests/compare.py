"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import numpy as np
import pandas as pd


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, floats as doubles, everything else as text; rows in the order of the texts, then of the rounded floats."""
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_float_dtype(out[c]) or out[c].map(type).isin([float]).any():
            out[c] = pd.to_numeric(out[c], errors="coerce")
            out[c] = out[c].astype(int).astype(str) if out[c].notna().all() and (out[c] % 1 == 0).all() and (out[c].abs() < 2**53).all() else out[c]
        else:
            out[c] = out[c].astype(str).str.replace(" 00:00:00", "").replace({"NaT": "None", "nan": "None", "<NA>": "None"})
    return out


def assert_same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    """The same rows: texts, whole numbers and truth values exactly, doubles to a billionth of their size."""
    assert sorted(got.columns) == sorted(wanted.columns)
    a, b = normal(got), normal(wanted)
    assert len(a) == len(b)
    floats = [c for c in a.columns if a[c].dtype == float or b[c].dtype == float]
    for c in floats:
        a[c], b[c] = pd.to_numeric(a[c], errors="coerce"), pd.to_numeric(b[c], errors="coerce")
    keys = [c for c in a.columns if c not in floats]
    a, b = (x.assign(**{f"_{c}": x[c].round(3) for c in floats}).sort_values([*keys, *[f"_{c}" for c in floats], *floats]).reset_index(drop=True) for x in (a, b))
    differ = pd.Series(False, index=a.index)
    for c in keys:
        differ |= a[c] != b[c]
    for c in floats:
        differ |= ~np.isclose(a[c], b[c], rtol=1e-9, atol=1e-9, equal_nan=True)
    assert not differ.any(), f"\n{a[differ].head(5)}\n{b[differ].head(5)}"
