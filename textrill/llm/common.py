"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import unicodedata

from textrill.runtime import materialize, shared_dir, spread, table  # noqa: F401


_FOLD = {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d", ord("ı"): "i"}
_MARKS = re.compile("[̀-ͯ]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower())).translate(_FOLD)
