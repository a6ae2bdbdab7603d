"""Rule patterns in the dialect of Python's ``re``, translated once to the engine that runs them.

Every rule set goes through ``to_java``, whatever its size, so the number of rules never changes what one of them
finds. The two dialects differ in their classes (``\\s``, ``\\w``), word boundaries, ends of text, line ends and set
operations inside classes; those are rewritten. What has no counterpart is refused before any row is read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants, _parser

#: Java flags: classes and case by Unicode, and a line feed as the only line end.
FLAGS = "(?dU)"
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"
_OUTSIDE = {
    "w": f"[{_WORD}]",
    "W": f"[^{_WORD}]",
    "s": f"[{_SPACE}]",
    "S": f"[^{_SPACE}]",
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
    "B": f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))",
    "Z": r"\z",
    "v": r"\x0b",
}
_INSIDE = {"w": _WORD, "s": _SPACE, "v": r"\x0b", "b": r"\x08"}
_COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAG = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]")
#: Alternatives that required texts are spelled out to.
_FEW = 16
_GROUPS = ("(?:", "(?=", "(?!", "(?<=", "(?<!", "(?>")


class UnsupportedPattern(ValueError):
    """A rule that cannot be translated."""


def _refuse(pattern: str, what: str) -> None:
    raise UnsupportedPattern(f"{what} is not supported in rules: {pattern!r}")


def _class(pattern: str, at: int) -> tuple[str, int]:
    """Translation of the class that begins at ``at``, and the place after it."""
    out, i = ["["], at + 1
    if pattern.startswith("^", i):
        out.append("^")
        i += 1
    first = i
    while pattern[i] != "]" or i == first:
        char = pattern[i]
        if char == "\\":
            following = pattern[i + 1]
            if following in "WSDB":
                _refuse(pattern, f"\\{following} inside a class")
            out.append(_INSIDE.get(following, pattern[i : i + 2]))
            i += 2
            continue
        # Java reads these as nested classes and set operations
        out.append("\\" + char if char in "[&]^" else char)
        i += 1
    return "".join(out) + "]", i + 1


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    """The pattern in Java's dialect, flags included; raises ``UnsupportedPattern`` where there is none."""
    re.compile(pattern)
    out, i = [FLAGS], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            following = pattern[i + 1]
            if following == "0":
                _refuse(pattern, "an octal escape")
            if following == "N":
                _refuse(pattern, "a named character")
            out.append(_OUTSIDE.get(following, pattern[i : i + 2]))
            i += 2
        elif char == "[":
            translated, i = _class(pattern, i)
            out.append(translated)
        elif pattern.startswith("(?", i):
            opening = next((g for g in _GROUPS if pattern.startswith(g, i)), None)
            flags = _FLAG.match(pattern, i)
            if opening is None and flags is not None and not set(flags[1] + (flags[2] or "")) - set("ims-"):
                opening = flags[0]
            if opening is None:
                _refuse(pattern, f"{pattern[i : i + 4]!r}")
            out.append(opening)
            i += len(opening)
        elif char == "{":
            count = _COUNT.match(pattern, i)
            if count is None or not (count[1] or count[3]):
                out.append(r"\{")
                i += 1
            else:
                out.append("{" + (count[1] or "0") + count[2] + count[3] + "}")
                i = count.end()
        else:
            out.append("\\}" if char == "}" else char)
            i += 1
    return "".join(out)


def required_texts(pattern: str) -> frozenset[str] | None:
    """Texts of which every match of the pattern holds at least one, as long as can be told; None if there is no such set.

    Only parts that must be matched count, letter by letter: choices give the texts of all their branches, and classes,
    repetitions that may be empty, and parts that ignore case give none.
    """
    return _required(_parser.parse(pattern)) if not re.compile(pattern).flags & re.IGNORECASE else None


def _exact(kind, value) -> frozenset[str] | None:
    """All texts that a part of a pattern matches, if they are few."""
    if kind is _constants.LITERAL:
        return frozenset([chr(value)])
    if kind is _constants.IN and all(k is _constants.LITERAL for k, _ in value):
        return frozenset(chr(v) for _, v in value)
    if kind is _constants.SUBPATTERN and not value[1]:
        return _exactly(value[3])
    if kind is _constants.BRANCH:
        each = [_exactly(branch) for branch in value[1]]
        return frozenset().union(*each) if None not in each else None
    if kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[:2] == (0, 1):
        own = _exactly(value[2])
        return own | {""} if own is not None else None
    return None


def _exactly(parts) -> frozenset[str] | None:
    texts = frozenset([""])
    for kind, value in parts:
        own = _exact(kind, value)
        if own is None or len(texts) * len(own) > _FEW:
            return None
        texts = frozenset(a + b for a in texts for b in own)
    return texts


def _required(parts) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = frozenset([""])
    for kind, value in [*parts, (None, None)]:
        own = _exact(kind, value)
        if own is not None and len(run) * len(own) <= _FEW:
            run = frozenset(a + b for a in run for b in own)
            continue
        found.append(run)
        run = own if own is not None and len(own) <= _FEW else frozenset([""])
        inner = None
        if kind is _constants.SUBPATTERN and not value[1]:
            inner = _required(value[3])
        elif kind is _constants.BRANCH:
            each = [_required(branch) for branch in value[1]]
            inner = frozenset().union(*each) if None not in each else None
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        if inner:
            found.append(inner)
    return max((t for t in found if "" not in t), key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)
