"""Token ids of whole texts by the tokenizers library, with the ids of each distinct word kept.

The tokenizer file word_bpe_49k.json drops white space and never merges across it, so the ids of a text are those of its
white-space separated words. A word of Latin-1 letters is one unit for its merges, also before a closing mark, and goes
straight to the library's BPE model; other words go through the whole library, and texts that hold a special token or a
character on whose class the library and Python differ go through it whole.
"""

from __future__ import annotations

import os
import re
from array import array

from folioflow.llm.common import LONG_WORD, held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space for Python but not for the tokenizer, and the start of any special token.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")
#: Byte-level BPE writes the bytes 127 to 160 and 173 as characters from U+0121 on.
_BYTE_LEVEL = {byte: 0x121 + i for i, byte in enumerate([*range(127, 161), 173])}
#: Characters of text that are encoded at once: the more, the fewer lookups.
CHARS = 4 << 20


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit integers. Words are kept in two generations of at most limit words:
    when the young one is full it becomes the old one."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        self.model = self.library.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Of lower-case Latin-1 letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, words: set[str]) -> None:
        """Adds words that are not in the young generation."""
        young, old, rest = self.young, self.old, []
        for word in words:
            value = old.get(word)
            if value is None:
                if max(word) > "\xff":
                    rest.append(word)
                    continue
                head, mark = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
                if not head.isalpha():
                    rest.append(word)
                    continue
                head = head.lower()
                value = young.get(head) or old.get(head)
                if value is None:
                    value = young[head] = self._letters(head)
                if mark:
                    if mark not in young:
                        young[mark] = self._plain([mark])[0]
                    value += young[mark]
            young[word] = value
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            young.update(zip(some, self._plain(some), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, without special tokens."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        split = [None if _WHOLE.search(t) else t.split() for t in texts]
        words = set().union(*(s for s in split if s)).difference(self.young)
        self.learn(words)
        get = self.young.__getitem__
        out = [self._plain([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]
        for word in words:
            if len(word) >= LONG_WORD:
                for key in (word, word.lower(), word[:-1].lower()):
                    self.young.pop(key, None)
        return out


def word_tokens(path: str, words_kept: int = 700_000) -> WordTokens:
    """One per Python worker and file."""
    return held("tokens", f"{path} {words_kept}", lambda: WordTokens(path, words_kept))


def default_word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
