"""Places of a needle in one text, left to right, without overlap."""

import pandas as pd


def positions(hay, needle):
    out, at = [], hay.find(needle)
    while at >= 0:
        out.append(at)
        at = hay.find(needle, at + len(needle))
    return out


def all_positions(hay: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([positions(h, n) for h, n in zip(hay, needle)])
