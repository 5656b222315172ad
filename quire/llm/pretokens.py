"""Pre-tokens of the byte-level vocabulary, cut exactly as its library cuts them.

The standard ``re`` module is the fast path. It agrees with the library's own pattern on texts of
the characters in ``PLAIN`` only (its letter and digit classes differ elsewhere); a text with any
other character is for the library itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Letters of the fast path: Latin and Cyrillic.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
#: The public pattern of this vocabulary, in classes that ``re`` is quick with.
PATTERN = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: White space, printable ASCII, Latin and Cyrillic letters, general punctuation.
OTHER = re.compile("[^\t-\r -~¡-©«-±´¶-¸»¿-ɏЀ-ҁҊ-ԯ‐-‧‰-⁞]")
#: A cut here never changes the pre-tokens: between a non-space and a single space before a non-space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where no pre-token can span."""
    at = 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def load(path: str):
    """The library's tokenizer, single-threaded, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def special_strings(tok) -> list[str]:
    """Strings that the library takes as one id wherever a text has them."""
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


class Coder:
    """Ids of texts and of single pre-tokens; every id comes from the library."""

    def __init__(self, path: str) -> None:
        self.tok = load(path)
        self.special = special_strings(self.tok)
        self.letters = _byte_alphabet()
        self.model = self.tok.model

    def pre_token(self, piece: str) -> list:
        """The library's tokens of one pre-token."""
        if piece.isascii() and (bare := piece[1:] if piece[0] == " " else piece).isalnum():
            # Letters and digits stand for themselves, only a space before them does not.
            spelled = piece if bare is piece else self.letters[0x20] + bare
        else:
            spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return self.model.tokenize(spelled)

    def plain(self, text: str) -> bool:
        """Whether ``PATTERN`` cuts this text as the library does, with no special string inside."""
        return not OTHER.search(text) and not any(s in text for s in self.special)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids


#: Characters of the longest pre-token that is kept in a cache.
LONGEST = 100


class Cache(dict):
    """Pre-token -> value, worked out once and kept: ``fixed`` for good, the rest in two generations.

    When ``most`` new entries are in, they become the old generation; an entry used again moves
    back. So at most ``2 * most`` entries are held and the frequent ones stay. Pieces of more than
    LONGEST characters are never kept, so the entries' bytes are bounded too.
    """

    def __init__(self, value: Callable[[str], object], fixed: dict, most: int) -> None:
        super().__init__(fixed)
        self.value, self.fixed, self.most = value, fixed, most
        self.old: dict = {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.value(piece)
            if len(piece) > LONGEST:
                return found
        if len(self) - len(self.fixed) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[piece] = found
        return found
