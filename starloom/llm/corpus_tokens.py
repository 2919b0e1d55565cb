"""Encoding of a whole corpus with a public byte-level tokenizer, and decoding.

The tokenizers library runs over Arrow batches inside tasks; the vocabulary file is read once per Python worker from a
path that is a parameter.  A null text and an empty text both encode to an empty list of ids.  Texts are encoded whole;
the strings of special tokens inside a text are ordinary text and no special token is added.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans.durable import spread

TOKENIZER_FOLDER = os.environ.get("STARLOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT_FILE = "byte_bpe_50k.json"
BATCH = 256
CACHED_PIECES = 200_000  # per Python worker; the cache starts anew beyond it

# White space as the tokenizer's own splitting pattern sees it.
_SPACES = re.compile("([ \\t-\\r\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+)")
_CLOCK = re.compile(r"[0-9]+(?:[:,.][0-9]+)+")
_RUNS = re.compile(r"[0-9]+|[:,.]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task; Spark runs the tasks
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def pieces(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes independently of each other; joined, they are the text.

    The tokenizer never merges across the end of a run of white space, of which one last blank belongs to the next word,
    nor between digits and punctuation.
    """
    found: list[str] = []
    lead = ""
    for n, part in enumerate(_SPACES.split(text)):
        if n % 2:
            if part == " ":
                lead = " "
                continue
            blank = part[-1] == " "
            lead = " " if blank else ""
            if len(part) > 1:
                found.append(part[:-1])
            if not blank:
                found.append(part[-1])
        elif part:
            if _CLOCK.fullmatch(part):
                runs = _RUNS.findall(part)
                runs[0] = lead + runs[0]
                found += runs
            else:
                found.append(lead + part)
            lead = ""
    return found + [lead] if lead else found


def _trailing(text: str) -> tuple[str, str]:
    """(text without its last run of white space, that run): at the end of a text the run is one piece."""
    parts = _SPACES.split(text)
    if len(parts) > 1 and parts[-1] == "":
        return text[: len(text) - len(parts[-2])], parts[-2]
    return text, ""


def _split(text: str) -> list[str]:
    body, end = _trailing(text)
    return pieces(body) + [end] if end else pieces(body)


def encode_texts(texts: list[str], loaded, cache: dict[str, list[int]]) -> list[list[int]]:
    """Ids of each text; each distinct piece is given to the tokenizers library once per cache."""
    if len(cache) > CACHED_PIECES:
        cache.clear()
    split = [_split(text) for text in texts]
    fresh = list({p for parts in split for p in parts if p not in cache})
    for piece, found in zip(fresh, loaded.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
        cache[piece] = found.ids
    return [[i for p in parts for i in cache[p]] for parts in split]


class PieceRanges:
    """Ids and character ranges of the pieces met so far, in flat arrays; at most about CACHED_PIECES of them at a time."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.length, self.count, self.first, self.ids, self.starts, self.ends = (np.array([], dtype=np.int64) for _ in range(6))

    def add(self, fresh: list[str], loaded) -> None:
        found = loaded.encode_batch(fresh, add_special_tokens=False)
        counts = np.array([len(e.ids) for e in found], dtype=np.int64)
        ranges = np.array([o for e in found for o in e.offsets], dtype=np.int64).reshape(-1, 2)
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.count, self.length = np.concatenate([self.count, counts]), np.concatenate([self.length, np.array([*map(len, fresh)], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array([i for e in found for i in e.ids], dtype=np.int64)])
        self.starts, self.ends = np.concatenate([self.starts, ranges[:, 0]]), np.concatenate([self.ends, ranges[:, 1]])


def encode_ranges(texts: list[str], loaded, cache: PieceRanges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, ids, starts, ends) of some texts, token lists end to end: text k has those from bounds[k] to bounds[k + 1].

    The ranges are those of the pieces, moved to where these stand in their text.
    """
    if len(cache.number) > CACHED_PIECES:
        cache.__init__()
    split = [_split(text) for text in texts]
    fresh = list(dict.fromkeys(p for parts in split for p in parts if p not in cache.number))
    if fresh:
        cache.add(fresh, loaded)
    piece = np.array([cache.number[p] for parts in split for p in parts], dtype=np.int64)
    text_ends = np.cumsum([0, *map(len, split)])
    length, count = cache.length[piece], cache.count[piece]
    places, tokens = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(count)])
    in_text = places[:-1] - np.repeat(places[text_ends[:-1]], np.diff(text_ends))
    at = np.arange(tokens[-1]) + np.repeat(cache.first[piece] - tokens[:-1], count)
    shift = np.repeat(in_text, count)
    return tokens[text_ends], cache.ids[at], cache.starts[at] + shift, cache.ends[at] + shift


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed to bytes.

    Printable Latin-1 characters stand for themselves; the other bytes take the characters from 256 on, in order.
    """
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in kept}
    table.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(kept))})
    return table


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    loaded, table = _tokenizer(path), byte_table()
    pieces = [loaded.id_to_token(i) for i in range(loaded.get_vocab_size())]
    return [bytes(table[c] for c in p) if all(c in table for c in p) else p.encode("utf-8") for p in pieces]


def _file(path: str | None) -> str:
    return path or str(Path(TOKENIZER_FOLDER) / DEFAULT_FILE)


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row; repeated rows stay repeated, an empty table gives no rows."""
    path = _file(path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, cache = _tokenizer(path), {}
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                ids = encode_texts([t or "" for t in part.column(1).to_pylist()], loaded, cache)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["key", "ids"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, ids array<int>").select(
        F.col("key").alias(key), "ids"
    )


def encode_with_offsets(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids, starts, ends): also the half-open range of characters that each token covers.

    A character split over several tokens has all of them cover it.
    """
    path = _file(path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, cache = _tokenizer(path), PieceRanges()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                bounds, *flat = encode_ranges([t or "" for t in part.column(1).to_pylist()], loaded, cache)
                arrays = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(f, pa.int32())) for f in flat]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["key", "ids", "starts", "ends"])

    schema = f"key {kind}, ids array<int>, starts array<int>, ends array<int>"
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, schema).select(
        F.col("key").alias(key), "ids", "starts", "ends"
    )


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): bytes of the ids joined and read as UTF-8, so characters split over tokens come back whole.

    Bytes that are no UTF-8 (a list cut inside a character) become U+FFFD; null ids give an empty text.
    """
    path = _file(path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(path)
        for batch in batches:
            texts = [b"".join([pieces[i] for i in x or ()]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").select(
        F.col("key").alias(key), "text"
    )
