"""Token ids of whole texts by a word-wise tokenizer, with a bounded cache of words.

For a tokenizer that lower-cases, drops white space and merges within its words only, the ids
of a text are those of its words one after another, so a word seen before need not be
encoded again. Texts of plain characters are split into words by an equal pattern and their
new words go to the model alone; any other stretch between white space goes through the
whole tokenizer."""

from __future__ import annotations

import re
from array import array

_LETTERS = "a-zß-öø-ÿ"
# characters whose lower case and classes are beyond doubt; no apostrophe
PLAIN = re.compile(r"[\x20\t\n\r!-&(-~À-ÖØ-öø-ÿ]*")
WORD = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\x20\t\n\r]+")
WHITE = re.compile(r"[\x20\t\n\r]+")


class WordEncoder:
    """Encodes texts to little-endian 32-bit ids. About twice ``limit`` words are kept: those of
    the present generation and of the one before."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        marks = [chr(c) for c in (*range(33, 127), *range(0xDF, 0x100))]
        self.bytes_of = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in marks})
        self.limit = limit
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @staticmethod
    def _is_plain(text: str) -> bool:
        return "<|" not in text and PLAIN.fullmatch(text) is not None  # "<|" begins special tokens

    def _plain(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.bytes_of))]).tobytes()

    def _other(self, stretch: str) -> bytes:
        return array("I", self.tokenizer.encode(stretch, add_special_tokens=False).ids).tobytes()

    def _words(self, text: str) -> list[str]:
        """Words of a text. A stretch that is not plain is marked by a leading space."""
        if self._is_plain(text):
            return WORD.findall(text.lower())
        found = []
        for stretch in WHITE.split(text):
            if self._is_plain(stretch):
                found += WORD.findall(stretch.lower())
            else:
                found.append(" " + stretch)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        split = [self._words(t) for t in texts]
        need = set().union(*split)
        for word in need.difference(self.now):
            ids = self.before.get(word)
            if ids is None:
                ids = self._other(word[1:]) if word[0] == " " else self._plain(word)
            self.now[word] = ids
        of = self.now.__getitem__
        out = [b"".join(map(of, words)) for words in split]
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        return out
