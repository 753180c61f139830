"""Word-cached encoding with a public tokenizer file; the ids are those of ``tokenizers`` itself."""

from __future__ import annotations

import re
import unicodedata
from array import array

import regex
from tokenizers import Tokenizer

_SHARED: dict[str, "WordTokenizer"] = {}

#: White space that str.split() takes and the tokenizer's own rule does not, or not alike.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class WordTokenizer:
    """Encodes word by word with bounded caches.

    White space always ends a word in this kind of vocabulary, so a text's ids are those of its
    words one after another. Words of letters and signs below U+0250 go through the model alone;
    anything else is encoded by the tokenizer as it is.
    """

    def __init__(self, path: str, cached_words: int = 300_000, cached_pieces: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cached_words, self.cached_pieces = cached_words, cached_pieces

    @classmethod
    def shared(cls, path: str) -> "WordTokenizer":
        """One for each Python worker, which serves many tasks."""
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.pieces) >= self.cached_pieces:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._piece(word.lower())
            if word[:-1].isalpha() and word[-1] in ".,":
                return self._piece(word[:-1].lower()) + self._piece(word[-1])
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._whole(word)
        return b"".join(map(self._piece, _PIECE.findall(unicodedata.normalize("NFC", word).lower())))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as native unsigned 32-bit integers (little-endian on the machines that Spark runs on)."""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        words, cache = text.split(), self.words
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) >= self.cached_words:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self._word(w)
        return b"".join([cache[w] for w in words])
