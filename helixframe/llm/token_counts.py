"""Edit-aware token counts.

A document's text is cut at every border of its pre-tokens, which tokens never cross, and each pre-token is a leaf of a
segment tree that holds characters and tokens of each subtree. Pre-tokens are found from left to right and each depends
only on what follows its start, so an edit changes those from the one just before it (a character of context) up to the first
border behind it where old and new borders meet. These are encoded again and the sums on the way to the root updated; all
other leaves keep their counts. Where an edit makes more pre-tokens than it replaces, the last of their leaves holds the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.encoders import encoder, pattern, public_path

#: Different pre-tokens whose counts a task remembers at most.
KNOWN = 1 << 18
#: Leaves that are read at a time in search of the border where an edit ends.
AHEAD = 8


class Counts(dict):
    """Tokens of each pre-token, encoded once."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(self) >= KNOWN:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenTree:
    """Leaves are pre-tokens of a text that changes; sums[:, 1] is the root, sums[:, size + k] leaf k."""

    def __init__(self, text: str, counts: Counts, split: regex.Pattern | None = None) -> None:
        self.counts, self.split = counts, split or pattern()
        self.parts = self.split.findall(text) or [""]
        self.size = 1 << max(0, len(self.parts) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[0, self.size : self.size + len(self.parts)] = list(map(len, self.parts))
        self.sums[1, self.size : self.size + len(self.parts)] = list(map(counts.__getitem__, self.parts)) if text else 0
        at = self.size
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at : 2] + self.sums[:, at + 1 : 2 * at : 2]
            at //= 2
        #: Characters that were encoded again.
        self.encoded = 0

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[0, 1])

    def text(self) -> str:
        return "".join(self.parts)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.sums[0, node]:
                before += int(self.sums[0, node])
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, part: str, tokens: int) -> None:
        self.parts[leaf] = part
        node = self.size + leaf
        change = np.array([len(part), tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end (exclusive), as the text now stands."""
        n = self.n_chars
        if not 0 <= start <= end <= n:
            raise ValueError(f"edit {start}-{end} of a text of {n} characters")
        first, before = self._find(max(0, start - 2)) if n else (0, 0)
        last, past = self._find(end) if end < n else (len(self.parts) - 1, 0)
        old = self.parts[first : last + 1]
        # Old borders behind the edit, as they are in the new text counted from `before`; the last is that of what is read.
        shift = len(new) - (end - start)
        while True:
            whole = "".join(old)
            text = whole[: start - before] + new + whole[end - before :]
            after, at = {}, 0
            for k, part in enumerate(old):
                at += len(part)
                if at >= end - before and part:
                    after.setdefault(at + shift, k)
            all_read = first + len(old) == len(self.parts)
            found, at = [], 0
            for m in self.split.finditer(text):
                found.append(m[0])
                at = m.end()
                # A border that what is not read yet can't move: two characters of it are here.
                if at in after and (all_read or at + 2 <= len(text)):
                    break
            else:
                if not all_read:
                    old += self.parts[first + len(old) : first + len(old) + AHEAD]
                    continue
                at = len(text)
            break
        self.encoded += at
        slots = (after[at] if at in after else len(old) - 1) + 1
        leaves = [[x] for x in found[: slots - 1]] + [found[slots - 1 :]]
        for k in range(slots):
            pieces = leaves[k] if k < len(leaves) else []
            if pieces or self.parts[first + k]:
                self._set(first + k, "".join(pieces), sum(self.counts[x] for x in pieces))


def edited_counts(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]], path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded_again, edited_text) for each row of docs.

    edits(text) names the edits of a text as (start, end, new), in ascending order and without overlap. Tokens are
    counted before and after them. A null text is empty, without tokens; a null id stays null; rows that repeat an id
    are counted each for itself. One pass without a shuffle: memory is bounded by a batch of texts and one tree. A word of any
    length is a single leaf.
    """
    path = path or public_path("byte_bpe_50k.tiktoken")
    names = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded_again long, edited_text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special=False)
        counts, split = Counts(lambda t: len(encode(t))), pattern()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = TokenTree(text, counts, split)
                before, todo = tree.n_tokens, edits(text)
                for start, end, new in reversed(todo):  # from the end on, so that places before stay as they are
                    tree.edit(start, end, new)
                for column, x in zip(out, (before, len(todo), tree.n_tokens, tree.encoded, tree.text()), strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], [n.split()[0] for n in names.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, names)


_ADDRESS = re.compile(r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?<![A-Za-z0-9])\+?[0-9](?:[ -]?[0-9]){8,13}(?![A-Za-z0-9])")


def masked_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask e-mail addresses and phone numbers, as a clean-up before training would make them."""
    return [(m.start(), m.end(), "<mail>" if "@" in m[0] else "<phone>") for m in _ADDRESS.finditer(text)]
