"""A second opinion on doubtful JSON texts, used inside a vectorised function."""

import json

import pandas as pd

from rowlantern.functions import json_split


def _refuse(name):
    raise ValueError(name)


def is_json(text):
    if text is None:
        return None
    try:
        json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _deep(text)
    except ValueError as err:
        # A number too long to convert is still a number.
        return _deep(text) if "digits" in str(err) else False
    return True


def _deep(text):
    try:
        for _ in json_split.walk(text):
            pass
    except ValueError:
        return False
    return "\x00" not in text


def all_json(texts: pd.Series) -> pd.Series:
    return texts.map(is_json)
