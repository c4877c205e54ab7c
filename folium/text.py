"""String rules that the document model fixes: white space, letters and digits by Unicode category, lines, lengths."""

from __future__ import annotations

import re
import sys
import threading
import unicodedata
from contextlib import contextmanager

#: Zs, Zl, Zp, U+0009-000D and U+001C-001F; U+0085 and U+200B are no white space here.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f                  　"
#: The same as a class for Java and Python patterns.
SPACE_CLASS = r"[\t-\r\x1C-\x1F    -     　]"
#: What HTML folds.
HTML_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
LINE_ENDS = re.compile(r"\r\n|\n|\r")


def trim(s: str) -> str:
    return s.strip(SPACE)


def trim_end(s: str) -> str:
    return s.rstrip(SPACE)


def is_blank(s: str) -> bool:
    return not s.strip(SPACE)


def lines(s: str) -> list[str]:
    return LINE_ENDS.split(s)


def is_letter(c: str) -> bool:
    return len(c) == 1 and ord(c) <= 0xFFFF and unicodedata.category(c)[0] == "L"


def is_digit(c: str) -> bool:
    return len(c) == 1 and ord(c) <= 0xFFFF and unicodedata.category(c) == "Nd"


def width(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) + sum(c > "￿" for c in s)


def decode(content: bytes | None) -> str:
    """UTF-8; malformed bytes become U+FFFD, a byte order mark stays."""
    return (content or b"").decode("utf-8", "replace")


_DEEP = threading.Lock()


@contextmanager
def unbounded_depth():
    """Trees of any depth may be walked: calls of Python functions take memory from the heap, so only the interpreter's own limit goes."""
    with _DEEP:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))
    yield
