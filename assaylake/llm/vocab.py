"""Ids of the tokenizers library for blocks of texts.

The library's own model encodes each distinct word once. Strings of printable ASCII and Latin letters are cut into words
here, by the tokenizer's own pattern; all others, and those with a special token's brackets, go through the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

from assaylake.llm.pieces import PieceTable

_PLAIN = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


class LibraryWords:
    """Encodes strings with a tokenizer file; ``pattern`` cuts plain strings as the file does."""

    def __init__(self, path: str, pattern: str, lower: bool):
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.find, self.lower = Tokenizer.from_file(path), regex.compile(pattern).findall, lower
        self.words: dict[str, int] = {}
        self.model = self.tokenizer.model.tokenize

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[str, int] = {}
        code, lengths, other = [], [], []
        find, number, lower = self.find, numbers.setdefault, self.lower
        for i, s in enumerate(strings):
            if (s.isascii() or _PLAIN(s)) and "<|" not in s:
                if lower:
                    s = s.lower()
                # a word of letters, with the space before it if that counts, is one match of the pattern
                words = (s,) if (s[1:] if s[:1] == " " else s).isalpha() and (not lower or s[0] != " ") else find(s)
                lengths.append(len(words))
                code += [number(w, len(numbers)) for w in words]
            else:
                other.append(i)
                lengths.append(1)
                code.append(-len(other))
        ids = [[t.id for t in x] for x in map(self.model, [w.encode().decode("latin-1").translate(_LETTERS) for w in numbers])]
        ids += [x.ids for i in range(0, len(other), 64) for x in self.tokenizer.encode_batch([strings[j] for j in other[i : i + 64]], add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
        code = np.array(code, np.int64)
        code = np.where(code < 0, len(numbers) - 1 - code, code)
        size = count[code] if len(code) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(count) - count)[code] - (ends - size), size)] if len(code) else flat[:0]
        return out, np.diff(np.append(0, ends)[np.append(0, np.cumsum(lengths)).astype(np.int64)])


@lru_cache(maxsize=1)
def byte_level(path: str | None = None) -> PieceTable:
    """For byte_bpe_50k.json and files of its kind. One table serves all tasks of a worker."""
    import public_tokenizers

    return PieceTable(LibraryWords(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, lower=False), spaced=True, most=600_000)


def word_level(path: str | None = None, most: int = 350_000) -> PieceTable:
    """For word_bpe_49k.json and files of its kind: lower case, white space dropped. The table holds ``most`` pieces."""
    import public_tokenizers

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    return PieceTable(LibraryWords(path or public_tokenizers.path("word_bpe_49k.json"), pattern, lower=True), spaced=False, most=most)
