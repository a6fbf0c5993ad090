"""Length counters: how long a text is, in the unit that passages are sized by."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

Counter = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


def token_counter(encode: Callable[[str], list], keep: int = 200_000) -> Counter:
    """Counts an encoder's tokens and remembers recent texts."""
    return lru_cache(maxsize=keep)(lambda text: len(encode(text)))


def rank_file_counter(path: str, pattern: str) -> Counter:
    """Tokens of a byte-pair vocabulary in a rank file (base64 and rank on each line)."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return token_counter(tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
