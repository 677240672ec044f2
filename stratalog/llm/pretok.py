"""Splitting text by a tokenizer's pattern, and bringing vocabulary files to the executors."""

from __future__ import annotations

import hashlib
import re
from functools import cache
from pathlib import Path

import regex
from pyspark.sql import SparkSession

#: A vocabulary file is broadcast, so its size has a bound.
MAX_VOCABULARY_BYTES = 64 << 20
_NESTED = re.compile(r"\[[^\]]*\\[pPsSdDwW]")
_BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")


def _ranges(prop: str) -> str:
    """The code points of the basic plane that have a property, as the inside of a class."""
    has, out, start = regex.compile(prop).match, [], None
    for cp in range(0x10001):
        ok = cp < 0x10000 and not 0xD800 <= cp < 0xE000 and has(chr(cp)) is not None
        if ok and start is None:
            start = cp
        elif not ok and start is not None:
            out.append(f"\\u{start:04x}-\\u{cp - 1:04x}")
            start = None
    return "".join(out)


@cache
def splitter(pattern: str):
    """``findall`` of ``pattern``. Texts inside the basic plane go through the standard library's
    engine, with the property classes spelt out, which is some three times as fast; others through
    ``regex``. Both give the same pieces. A pattern with property classes inside other classes than
    the one that is rewritten goes through ``regex`` altogether."""
    general = regex.compile(pattern).findall
    if _NESTED.search(pattern.replace(r"[^\s\p{L}\p{N}]", "")) or re.search(r"\\\\|&&|--|\(\?[a-zA-Z]", pattern):
        return general
    letters, numbers, spaces = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\s")
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    if r"\p" in spelt or r"\P" in spelt:
        return general
    plain = re.compile(spelt).findall
    beyond = _BEYOND_BMP.search
    return lambda text: general(text) if beyond(text) else plain(text)


def shared_file(spark: SparkSession, path: str):
    """A broadcast of ``(digest, bytes)`` of a vocabulary file, whose size is checked first."""
    size = Path(path).stat().st_size
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    data = Path(path).read_bytes()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))
