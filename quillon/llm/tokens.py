"""Token ids of whole texts by a tokenizer file of the `tokenizers` library, as little-endian unsigned 32-bit bytes.

``WordEncoder`` keeps the ids of white-space tokens it has met, so a word is run through byte-pair merging once per worker
and not once per occurrence. That is exact because the tokenizer splits on white space before merging; texts with
characters outside a plainly safe set, and texts with added tokens, go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

END_OF_WORD = "</w>"
#: Printable ASCII and Latin letters: normal form C leaves them alone, and lower-casing is by single characters.
UNSAFE = re.compile("[^\t\n\r -~À-įı-ɏ]|<\\|")
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

_loaded: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a tokenizer file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


class WordEncoder:
    def __init__(self, path: str, most: int = 100_000):
        """most: entries of each of the two caches before they become the older ones, which are kept as long again.

        An older entry that is met again is a new one, so common words stay. Words over 64 characters are not kept.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokens: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_tokens: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith(END_OF_WORD)]] = True

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text without special tokens; null counts as empty."""
        if not text:
            return b""
        if UNSAFE.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        known = self.tokens
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self._learn(words)
            found = b"".join([self.tokens[w] for w in words])
            for held in (self.tokens, self.words):
                for w in [w for w in words if len(w) > 64]:
                    held.pop(w, None)
            return found

    def _learn(self, words: list[str]) -> None:
        if len(self.tokens) > self.most:
            self.tokens, self.older_tokens = {}, self.tokens
        if len(self.words) > self.most:
            self.words, self.older_words = {}, self.words
        missing = {w for w in words if w not in self.tokens}
        parts = {}
        for w in missing:
            if (ids := self.older_tokens.get(w)) is not None:
                self.tokens[w] = ids
            else:
                parts[w] = PIECES.findall(w)
        for piece in [p for ps in parts.values() for p in ps if p not in self.words and p in self.older_words]:
            self.words[piece] = self.older_words[piece]
        new = list(dict.fromkeys(p for ps in parts.values() for p in ps if p not in self.words))
        if new:
            ids = np.asarray(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(new):
                raise ValueError("the tokenizer does not mark the end of each word")
            at = 0
            for word, cut in zip(new, cuts.tolist(), strict=True):
                self.words[word] = ids[at:cut].tobytes()
                at = cut
        for w, ps in parts.items():
            self.tokens[w] = b"".join([self.words[p] for p in ps])
