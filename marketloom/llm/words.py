"""Words of a text as numbers, for operators that compute on arrays of words."""

from __future__ import annotations

from collections.abc import Iterator

from .common import Cache


def blocks(text: str, size: int = 500_000) -> Iterator[str]:
    """The text in blocks of about `size` characters that end before white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class Numbered:
    """Numbers words in order of appearance; `describe` gets a word and its number when it is new.

    The numbers start anew when `limit` words are known, so they hold for one block only.
    """

    def __init__(self, describe, limit: int = 400_000):
        self.describe, self.limit = describe, limit
        self.known = Cache(self._new, limit + 1)

    def _new(self, word: str) -> int:
        number = len(self.known)
        self.describe(word, number)
        return number

    def __call__(self, words: list[str]) -> map:
        """The numbers of at most `limit` words."""
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        return map(self.known.__getitem__, words)
