"""Byte-level BPE token ids. The vocabulary files are read where they lie and never copied."""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np


def default_paths() -> tuple[str, str]:
    """(tokenizer file, the same vocabulary as ranks)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _coders(paths: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(paths[0])


#: Texts with this string hold a special token, which only the tokenizer file tells.
_SPECIAL = "<|endoftext|>"


def token_ids(text: str | None, paths: tuple[str, str]) -> np.ndarray:
    """The ids of the tokenizer file, without special tokens added. Both libraries give the same ids (tests hold them
    against each other); the ranks are several times faster."""
    fast, exact = _coders(paths)
    if not isinstance(text, str) or not text:
        return np.zeros(0, dtype="<u4")
    if _SPECIAL in text:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
