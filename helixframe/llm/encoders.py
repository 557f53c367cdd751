"""Public tokenizers by the path of their vocabulary file; loaded once a worker."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
import regex

#: Added tokens of the public vocabulary, which a file of ranks does not list.
SPECIAL = {"<|endoftext|>": 50256}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def pattern() -> regex.Pattern:
    """The vocabulary's pattern of pre-tokens, which no token crosses."""
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def encoder(path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Text to ids (uint32). A .json file is read by tokenizers; a .tiktoken file of ranks by tiktoken, which gives the
    same ids for the same vocabulary, several times faster. The string of the special token is that token, as it is to
    tokenizers by default, or ordinary text if not `special`."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = not special
        return lambda text: np.array(model.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    encode = functools.partial(coding.encode, allowed_special="all") if special else coding.encode_ordinary
    return lambda text: np.array(encode(text), np.uint32)
