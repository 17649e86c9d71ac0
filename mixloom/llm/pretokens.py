"""Pre-token patterns for the standard regular expression module, with the letters and digits of the library.

Unicode versions differ between libraries, so the classes are asked from the tokenizer library itself, once on the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

# Contractions that both tokenizers split off, and Unicode's white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
PLANE = 0x10000

Ranges = tuple[tuple[int, int], ...]


def _runs(pattern: str) -> Ranges:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    code_points = [*range(0xD800), *range(0xE000, 0x110000)]
    split = Split(Regex(pattern), behavior="removed", invert=True)
    found = split.pre_tokenize_str("".join(map(chr, code_points)))
    return tuple((code_points[a], code_points[b - 1]) for _, (a, b) in found)


def classes() -> dict[str, Ranges]:
    """Code point ranges of letters and numbers as the tokenizer library knows them."""
    return {"L": _runs(r"\p{L}+"), "N": _runs(r"\p{N}+")}


def unlike() -> Ranges:
    """Code points that the library may lower-case or compose in another way than Python.

    These are the ones whose lower case differs, and those that Python's Unicode version does not know: what it knows is composed
    alike by all later versions.
    """
    from tokenizers.normalizers import Lowercase

    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    lowered = Lowercase().normalize_str("\n".join(map(chr, points.tolist()))).split("\n")
    # The new line itself is a code point too: it leaves one empty piece more.
    lowered[0x0A : 0x0C] = ["\n"]
    odd = [unicodedata.category(chr(p)) == "Cn" or chr(p).lower() != low for p, low in zip(points.tolist(), lowered, strict=True)]
    odd = np.flatnonzero(odd)
    runs = np.split(points[odd], np.flatnonzero(np.diff(points[odd]) > 1) + 1)
    return tuple((int(r[0]), int(r[-1])) for r in runs if len(r))


def range_set(ranges: Ranges, limit: int = 0x110000) -> str:
    return "".join(
        re.escape(chr(a)) + "-" + re.escape(chr(min(b, limit - 1))) for a, b in ranges if a < limit
    )


def holder(ranges: Ranges) -> Callable[[str], object]:
    """A function that tells whether a text has a code point of `ranges`.

    Ranges beyond the first plane make a search slow, so one range for all of them comes first.
    """
    first = re.compile(f"[{range_set(ranges, PLANE)}\U00010000-\U0010ffff]").search
    every = re.compile(f"[{range_set(ranges)}]").search
    return lambda text: first(text) and every(text)


def finder(shape: Callable[[str, str, str], str], known: dict[str, Ranges]) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens. `shape(letters, numbers, white)` gives the pattern.

    Classes beyond the first plane make the search slow, so texts without such characters get a pattern without them.
    """

    def compiled(limit: int) -> Callable[[str], list[str]]:
        return re.compile(shape(range_set(known["L"], limit), range_set(known["N"], limit), range_set(WHITE, limit))).findall

    near, far = compiled(PLANE), compiled(0x110000)
    astral = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: (near if text.isascii() or not astral(text) else far)(text)


def word_shape(letters: str, numbers: str, white: str) -> str:
    """Words, single digits and runs of other characters; white space is dropped."""
    return f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+"


def byte_shape(letters: str, numbers: str, white: str) -> str:
    """The same with digits in runs, one leading blank, and white space kept in pieces of its own."""
    return (
        f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
        f"|[{white}]+(?![^{white}])|[{white}]+"
    )
