"""Quality rules, line first: clean the lines, then judge what is left of a document.

A line (``\\n``-split, with at least one word) is removed if it is

* navigation: separators such as ``|`` make up a quarter of its words or more;
* symbols: at least half as many of ``#*$%&|<>`` as words;
* boilerplate: it holds one of ``PHRASES`` (ASCII case doesn't matter);
* stuttered: a third of its words, at least, are the word before again;
* unpunctuated: under ``MIN_OPEN_WORDS`` words without an end mark, in a text
  of which some other line has one (so scripts and texts without any end mark
  aren't emptied).

A document is rejected if it fails a base rule (fewer than 10 words, or more
than 20 % of its words in repeated 5-word windows), or if the removed lines
hold more than ``MAX_LOST`` percent of the characters of its words.

Null and empty texts have no word, so all counts are 0 and they are rejected.
Repeated rows are judged one by one. The whole text is always read; memory is
in proportion to one slice of texts or to the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import give_back, slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Words that only part navigation entries.
SEPARATORS = ("|", "»", "›", "•", "·", "::", "/", ">")
END_MARKS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "”", "’", "»", "。", "！", "？", "」")
PHRASES = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "licensed under",
           "enable javascript", "lorem ipsum", "click here", "subscribe to our", "share this", "read more", "back to top")
MIN_OPEN_WORDS = 4
MAX_LOST = 50
REPEAT_WINDOW = 5

FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
          "n_lines": "bigint", "n_removed_lines": "bigint", "removed_chars": "bigint", "base_failed": "boolean", "kept": "boolean"}

_separators = {s.encode() for s in SEPARATORS}
_ends = tuple(s.encode() for s in END_MARKS)
_phrases = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in windows found twice or more, the first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    number = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    if len(codes) == len(words):
        return 0
    key, kinds = number[:n], len(codes)
    for k in range(1, window):
        if kinds > (1 << 62) // len(codes):  # rank anew, so that the next step fits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            kinds = int(key.max()) + 1
        key = key * len(codes) + number[k:k + n]
        kinds *= len(codes)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.append(same, False) | np.append(False, same)
    begins = order[twice]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "surrogatepass"))


def bad_line(line: bytes, words: list[bytes], punctuated: bool) -> bool:
    if 4 * sum(w in _separators for w in words) >= len(words):
        return True
    if 2 * (len(line) - len(line.translate(None, SYMBOLS))) >= len(words):
        return True
    if _phrases.search(line.lower()):
        return True
    if 3 * sum(a == b for a, b in zip(words, words[1:], strict=False)) >= len(words):
        return True
    return punctuated and len(words) < MIN_OPEN_WORDS and not words[-1].endswith(_ends)


def judge(text: str | None) -> tuple:
    """The values of ``FIELDS`` and the cleaned text."""
    data = (text or "").encode()
    words = data.split()
    lines = data.split(b"\n")
    of_line = [line.split() for line in lines]
    with_words = [line for line, w in zip(lines, of_line, strict=True) if w]
    chars = len(text or "") - (len(data) - len(data.translate(None, SPACES)))
    repeats = repeated_words(words)
    punctuated = any(w and w[-1].endswith(_ends) for w in of_line)
    bad = [bool(w) and bad_line(line, w, punctuated) for line, w in zip(lines, of_line, strict=True)]
    removed = sum(code_points(b"".join(w)) for w, b in zip(of_line, bad, strict=True) if b)
    base_failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    kept = not base_failed and 100 * removed <= MAX_LOST * chars
    cleaned = text if not any(bad) else b"\n".join(line for line, b in zip(lines, bad, strict=True) if not b).decode()
    return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(with_words) - len(set(with_words)), repeats,
            len(with_words), sum(bad), removed, base_failed, kept, cleaned)


def verdict(text: Column | str, with_text: bool = False) -> Column:
    """A struct of ``FIELDS`` for each text, and ``cleaned`` (its lines that stay) if asked for."""
    names = [*FIELDS, "cleaned"] if with_text else [*FIELDS]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
    types = [*(kinds[t] for t in FIELDS.values()), pa.string()][:len(names)]

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", cleaned string" * with_text)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([], type=pa.struct(list(zip(names, types, strict=True))))]
            for texts in slices(batch, 2 << 20):
                columns = list(zip(*map(judge, texts), strict=True))[:len(names)]
                parts.append(pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names))
            yield pa.concat_arrays(parts)
        give_back()

    return judged(text)


def judge_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``FIELDS`` of every row; other columns aren't read."""
    return docs.select("doc_id", verdict("text").alias("v")).select("doc_id", "v.*")


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with the lines that stay as ``text``; same columns.

    ``n_chars``, where there is one, is brought up to date. Other columns pass
    through untouched, whatever their names.
    """
    mark = "_".join([*docs.columns, "verdict"])  # longer than any name there
    judged = docs.withColumn(mark, verdict("text", with_text=True)).where(F.col(f"`{mark}`.kept"))
    text = F.col(f"`{mark}`.cleaned")
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return judged.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
