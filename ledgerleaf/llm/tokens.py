"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import per_text, with_id_type

#: Pieces that a text is cut into first: a run of white space with what follows it. A token never holds
#: white space after another character, so tokens never cross these cuts.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters on whose kind the library and Python's ``\s`` disagree.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Chunks remembered by each worker, and the longest one that is worth it.
CACHE_ROWS, CACHE_CHARS = 1_000_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges.

    The heap holds (rank, left position) of adjacent pairs; the list of live symbols is linked both
    ways. The lowest rank goes first, then the leftmost pair; an entry whose pair has changed since
    is skipped. The result is the initial count minus the merges made.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols = [*symbols]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or not symbols[i] or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class MergeCounter(dict):
    """Token counts of texts; remembers those of short chunks, up to ``CACHE_ROWS`` at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def fresh(self, text: str) -> int:
        symbols = self.symbols
        return sum(merged_length([symbols[b] for b in w.encode()], self.ranks) for w in self.split.findall(text))

    def __missing__(self, chunk: str) -> int:
        n = self.fresh(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[chunk] = n
        return n

    def plain(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return self.fresh(text)
        return sum(map(self.__getitem__, CHUNK.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of ``text``; a special string in it counts as one, as by the library's default."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; a name with a folder is taken as a path."""
    return name if os.sep in name else public_tokenizers.path(name)


def token_counts(
    df: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    One narrow pass; no shuffle. ``vocab`` names a vocabulary file that each executor has (installed
    with the tokenizer library). A null or empty text has 0 bytes and 0 tokens. Repeated rows and null
    ids each give their own row; other columns are ignored. An empty table gives an empty result.
    """
    schema = with_id_type(df, "n_bytes long, n_tokens long, over_limit boolean", id_col)

    def rows(key, text):
        n = counter(vocabulary(vocab)).count(text)
        return [(key, len(text.encode()), n, n > limit)]

    return per_text(df, rows, schema, id_col, text_col)
