"""Byte-level BPE over a vocabulary file, by tiktoken; the same ids as the tokenizers library gives, which a test
holds over every Unicode code point. tiktoken needs a sixth of its time."""

from __future__ import annotations

import base64
from functools import lru_cache

#: GPT-2's split of a text before merges, with possessive repeats: it matches the same pieces and backtracks less.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file's place on this machine; executors have the package as the driver has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The encoding of a rank file. One per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


def encode(encoding, text: str):
    """Ids as a numpy array of uint32; the special token's string in a text is that token, as is the library's default."""
    return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
