"""Token counts of sections from one encoding of the whole document.

A document is encoded once; each token's character span comes from the running sum of its bytes.
Sections or fields are half-open character spans, given as a table (key, section, char_start,
char_end) that is joined to the documents by key; without one, they are the text's lines, each with
its line end. Tokens and a document's spans are both in order, so the interval join within it is a
pair of binary searches.

A token that touches more than one section is allocated by ``rule``:
``majority``: to the section that holds most of its characters, the earlier one on a tie;
``start``: to the section that holds its first character;
``split``: to each section by its share of the token's characters.
A token of part of a character counts as touching that character. What no section covers counts as
one of its own, which gives no row. Spans reach no further than the text, and one that begins before
the one before it ends begins there. Whatever the rule, sections that cover a document sum to its tokens.

A null or empty text gives no rows, nor does a document without a section, or of a null key where
sections are given; an empty table gives none. A section of no characters has no tokens. Very long
texts are encoded whole, one at a time. Repeated rows give repeated counts. Columns besides the key
and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 1 << 22  # characters of texts whose tokens are held at a time


@dataclass(frozen=True)
class TokenCountOptions:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    rule: str = "majority"

    def __post_init__(self):
        if self.rule not in ("majority", "start", "split"):
            raise ValueError("rule must be majority, start or split")


_encodings: dict[int, tuple] = {}


def _encoding(raw: bytes):
    key = hash(raw)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            width[i] = len(t)
        _encodings[key] = (tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), width)
    return _encodings[key]


def token_spans(raw: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the text's tokens."""
    encoding, width = _encoding(raw)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    end = np.cumsum(width[ids])
    start = end - width[ids]
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) != len(text):
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters that begin before each byte
        inside = np.r_[(data & 0xC0) == 0x80, False]
        start, end = lead[start] - inside[start], lead[end]
    return start, end


def line_spans(text: str) -> np.ndarray:
    """Bounds of the lines, each with its line end: line i is [bounds[i], bounds[i + 1])."""
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cut = np.flatnonzero(data == 10) + 1
    return np.unique(np.r_[0, cut, len(data)])


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that touch it and another one)."""
    sections = len(bounds) - 1
    a = np.searchsorted(bounds, start, "right") - 1
    z = np.searchsorted(bounds, end, "left") - 1
    across = np.flatnonzero(z > a)
    single = z <= a
    tokens = np.bincount(a[single] if rule != "start" else a, minlength=sections).astype(np.float64)
    crossing = np.zeros(sections, np.int64)
    if len(across):
        n = (z - a + 1)[across]
        token = np.repeat(across, n)
        section = a[token] + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        share = np.minimum(end[token], bounds[section + 1]) - np.maximum(start[token], bounds[section])
        np.add.at(crossing, section, 1)
        if rule == "split":
            np.add.at(tokens, section, share / (end - start)[token])
        elif rule == "majority":
            order = np.lexsort((section, -share, token))
            first = order[np.r_[True, token[order][1:] != token[order][:-1]]]
            np.add.at(tokens, section[first], 1)
    return tokens, crossing


def given_spans(spans: list[dict], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(section, start, end) of the spans, none over another, and the bounds of all that they and the gaps cut."""
    section = np.array([s["section"] for s in spans], np.int64)
    start, end = (np.clip(np.array([s[c] for s in spans], np.int64), 0, size) for c in ("char_start", "char_end"))
    reached = np.r_[0, np.maximum.accumulate(end)[:-1]] if len(end) else end
    start = np.maximum(start, reached)
    end = np.maximum(start, end)
    return section, start, end, np.unique(np.r_[0, start, end, size])


def _rows(key: pa.Array, keys: list[np.ndarray], parts: list[tuple]) -> pa.RecordBatch:
    section, start, end, tokens, crossing = (np.concatenate(c) for c in zip(*parts, strict=True))
    columns = [key.take(pa.array(np.concatenate(keys))), pa.array(section.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(tokens), pa.array(crossing.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "section", "char_start", "char_end", "n_tokens", "n_crossing"])


def section_token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", options: TokenCountOptions = TokenCountOptions(), sections: DataFrame | None = None) -> DataFrame:
    """One row for each section: key, section, char_start, char_end, n_tokens, n_crossing.

    sections: key, section, char_start, char_end.
    """
    with open(options.vocabulary.removeprefix("file://"), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its size is fixed
    rule, given = options.rule, sections is not None
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        raw = shared.value
        for b in batches:
            keys, parts, held = [], [], 0
            texts = b.column("_text").to_pylist()
            spans = b.column("_spans").to_pylist() if given else None
            for i, t in enumerate(texts):
                if t:
                    if spans is None:
                        bounds = line_spans(t)
                        section, low, high = np.arange(len(bounds) - 1), bounds[:-1], bounds[1:]
                    else:
                        section, low, high, bounds = given_spans(spans[i], len(t))
                    tokens, crossing = attribute(*token_spans(raw, t), bounds, rule)
                    if spans is not None:
                        at, some = np.minimum(np.searchsorted(bounds, low), len(tokens) - 1), high > low
                        tokens, crossing = np.where(some, tokens[at], 0.0), np.where(some, crossing[at], 0)
                    keys.append(np.full(len(tokens), i))
                    parts.append((section, low, high, tokens, crossing))
                    held += len(t)
                if held > STRETCH:
                    yield _rows(b.column("key"), keys, parts)
                    keys, parts, held = [], [], 0
            if parts:
                yield _rows(b.column("key"), keys, parts)

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    if sections is not None:  # a document's spans stay together, as its text does
        span = F.struct("char_start", "char_end", F.col("section").cast("int").alias("section"))
        by_key = sections.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(span)).alias("_spans"))
        slim = slim.join(by_key, "key")
    found = slim.mapInArrow(run, f"key {kind}, section int, char_start long, char_end long, n_tokens double, n_crossing int")
    count = F.col("n_tokens") if rule == "split" else F.col("n_tokens").cast("long").alias("n_tokens")
    return found.select(F.col("key").alias(key), "section", "char_start", "char_end", count, "n_crossing")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"))
