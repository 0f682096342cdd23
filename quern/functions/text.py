"""Text functions that the JVM lacks, of Unicode normalization and nested payloads: Arrow batches of whole columns."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.scalar import MASK, SAFE_NAMES, SECRET_FORM, SECRET_NAMES, SECRET_PARAMETER

_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def words_of(text: str, segment: Callable[[str], list[str]] | None = None) -> list[str]:
    """Search tokens of a text: compatibility forms folded, lower case, segmented, then runs of letters and digits."""
    plain = unicodedata.normalize("NFKC", text).lower()
    return [w for part in (segment(plain) if segment else [plain]) for w in _WORD.findall(part)]


def search_tokens(text: Column, segment: Callable[[str], list[str]] | None = None) -> Column:
    """Search tokens as an array. `segment` plugs in a segmentation of languages without spaces; by default an ideograph
    is a token. Null has none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words_of(t, segment) if t is not None else [])

    return run(text)


def _clusters(text: str) -> list[str]:
    """Parts that compose among themselves alone: a character with the marks or conjoining letters after it; \\r\\n is one."""
    out: list[str] = []
    for c in text:
        joins = unicodedata.combining(c) or "\u1160" <= c <= "\u11ff" or (c == "\n" and out and out[-1] == "\r")
        if joins and out:
            out[-1] += c
        else:
            out.append(c)
    return out


def normal(text: str) -> tuple[str, list[int]]:
    """Line ends as \\n, canonical composition and no white space at the ends; and for each character, and the end, the
    place in the original text that it begins at. Most texts are normal but for their ends and take the short way."""
    if "\r" not in text and unicodedata.is_normalized("NFC", text):
        whole, places = text, list(range(len(text) + 1))
    else:
        parts, places, at = [], [], 0
        for cluster in _clusters(text):
            parts.append("\n" if cluster[0] == "\r" else unicodedata.normalize("NFC", cluster))
            places += [at] * len(parts[-1])
            at += len(cluster)
        whole, places = "".join(parts), [*places, at]
    left = len(whole) - len(whole.lstrip())
    kept = whole.strip()
    return kept, places[left : left + len(kept) + 1]


def normalized_text(text: Column) -> Column:
    """A text's normal form with the original place of each character, as a struct of text and places."""

    @F.pandas_udf("text string, places array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normal(t) if t is not None else (None, None) for t in texts], columns=["text", "places"])

    return run(text)


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, composition and white space aside."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        flat = lambda t: " ".join(unicodedata.normalize("NFC", t or "").split())
        return pd.Series([bool(flat(q)) and flat(q) in flat(t) for t, q in zip(texts, quotes)])

    return run(text, quote)


def _clean(value, masked: bool = False):
    """A value of JSON without secrets: see redacted_json."""
    if masked:
        return MASK
    if isinstance(value, dict):
        out = {}
        for name, inner in value.items():
            plain = name.lower().replace("-", "_")
            safe = any(p in plain for p in SAFE_NAMES)
            out[name] = inner if safe else _clean(inner, any(p in plain for p in SECRET_NAMES))
        return out
    if isinstance(value, list):
        return [_clean(v) for v in value]
    if isinstance(value, str):
        low = value.lower()
        if "authorization:" in low or "bearer " in low:
            return MASK
        return re.sub(SECRET_FORM, MASK, re.sub(SECRET_PARAMETER, rf"\g<1>{MASK}", value))
    return value


def redacted_json(payload: Column) -> Column:
    """A payload (JSON of any depth) without secrets: values of secret names are masked whole, those of safe names stay,
    other texts are redacted as free text, in objects and lists. What is no JSON is redacted as a text."""

    @F.pandas_udf("string")
    def run(payloads: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                value = json.loads(text)
            except ValueError:
                return _clean(text)
            return json.dumps(_clean(value), ensure_ascii=False, separators=(",", ":"))

        return payloads.map(one)

    return run(payload)
