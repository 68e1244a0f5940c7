"""Word rules that several operators share, on UTF-8 bytes inside tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame

#: A-Z to a-z; every ASCII byte that is no letter or digit to a space; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts of an Arrow array as bytes; null gives an empty text."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.translate(PLAIN).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space; bytes.split splits at 0x20 and 0x09-0x0D."""
    return text.lower().split()


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What a worker keeps for later tasks of one operator, until a task of another one gives it back."""
    return _kept.setdefault(operator, {})


def give_back(keep: str = "") -> None:
    """Drop what other operators kept in this worker and return unused memory to the system, where its C library can."""
    for operator, cache in _kept.items():
        if operator != keep:
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
