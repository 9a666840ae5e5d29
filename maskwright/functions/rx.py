"""Regex dialect helpers.

Patterns in ``values`` use ECMAScript rules: word boundaries, digits and word
characters are ASCII, ``\\s`` covers the Unicode spaces, ``$`` is the very end
of the text. The JVM engine differs on all of these, so every pattern passes
through :func:`java` before it reaches Spark.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD = "[A-Za-z0-9_]"
SPACE = "\t\n\x0b\f\r \u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_WORD = f"(?-i:(?<!{WORD}))"
_BOUNDARY = f"(?-i:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def _starts_with_word(rest: str) -> bool:
    """True when the token after a boundary can only match an ASCII word character."""
    if rest[:2] == r"\d" or rest[:1].isascii() and rest[:1].isalnum():
        following = rest[2:3] if rest[:1] == "\\" else rest[1:2]
        return following not in ("?", "*") and not rest.startswith(r"\d?")
    if rest.startswith("["):
        body, _, tail = rest[1:].partition("]")
        plain = body.replace(r"\d", "").replace("-", "")
        return plain.isascii() and (plain.isalnum() or not plain) and tail[:1] not in ("?", "*")
    return False


#: Syntax that ``java.util.regex`` takes and ECMAScript refuses: possessive and stacked quantifiers,
#: atomic groups, inline flags, named groups of another dialect.
_FOREIGN = (r"[*+?}][*+]", r"\(\?(?![:=!]|<[=!]|<[A-Za-z_$])", r"(?:^|[(|])[*+]|(?:^|\|)\?")


def ecmascript(pattern: str) -> bool:
    """False for what an ECMAScript engine would refuse though the JVM would not."""
    plain = re.sub(r"\\.", "x", pattern, flags=re.S)
    plain = re.sub(r"\[(?:\^)?[^\]]*\]", "x", plain)
    return not any(re.search(p, plain) for p in _FOREIGN)


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite an ECMAScript pattern for ``java.util.regex``."""
    out, i, in_class = [], 0, False
    # inside a class only ECMAScript's own signs keep a meaning; an empty class and its complement have none here
    pattern = re.sub(r"(?<!\\)\[\^\]", r"[\\s\\S]", pattern)
    pattern = re.sub(r"(?<!\\)\[\]", "(?!)", pattern)
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "u":
                out.append(chr(int(pattern[i + 2:i + 6], 16)))
                i += 6
                continue
            if nxt == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif nxt == "d":
                out.append("0-9" if in_class else "[0-9]")
            elif nxt == "b":
                out.append("\\x08" if in_class else _BEFORE_WORD if _starts_with_word(pattern[i + 2:]) else _BOUNDARY)
            elif nxt == "v":
                out.append("\\x0B")
            elif nxt.isascii() and nxt.isalpha() and nxt not in "BDSWcfknrtwx":
                out.append(nxt)  # any other letter stands for itself
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif in_class and (ch == "[" or ch == "&" and pattern[i + 1:i + 2] == "&"):
            out.append("\\")
        elif ch == "$" and not in_class:
            out.append(r"\z")
            i += 1
            continue
        out.append(ch)
        i += 1
    # Without the u flag only ASCII letters fold, which is right for ASCII words and faster.
    flags = ("(?i)" if pattern.isascii() else "(?iu)") if ignore_case else ""
    return flags + "".join(out)


def strip_boundaries(pattern: str) -> str:
    """A weaker pattern that any match of ``pattern`` inside a slice also satisfies."""
    return pattern.replace(r"\b", "")


def grouped(words, depth: int = 2) -> str:
    """Alternation of words, split by leading letter so that few are tried at a position.

    Words with different first letters exclude each other, so only the order
    among words with the same start matters, and that is kept.
    """
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = []
    for head, rests in heads.items():
        if depth > 1 and len(rests) > 1 and all(r == "" or r[0].isalpha() for r in rests):
            parts.append(head + grouped(rests, depth - 1))
        elif len(rests) > 1:
            parts.append(head + "(?:" + "|".join(rests) + ")")
        else:
            parts.append(head + rests[0])
    return "(?:" + "|".join(parts) + ")"


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return parts + [pattern[start:]]


def _head(word: str) -> str:
    """Leading literal of an alternative, with the boundary before it if any."""
    cut = 2 if word.startswith(r"\b") else 0
    first, after = word[cut:cut + 1], word[cut + 1:cut + 2]
    if first and first not in r"\[](){}.*+?^$|" and after not in ("?", "*", "+", "{"):
        return word[:cut] + (first.lower() if first.isascii() else first)
    return ""


@lru_cache(maxsize=None)
def finds(pattern: str, ignore_case: bool = True) -> str:
    """A JVM pattern that is found in the same texts as ``pattern``.

    Only for tests of presence, where the order of alternatives is free: they
    are grouped by first letter, and no word is tried at characters that start none.
    """
    ascii_heads: dict[str, list[str]] = {}
    other_heads: dict[str, list[str]] = {}
    for w in alternatives(pattern):
        head = _head(w)
        bucket = ascii_heads if head and head.isascii() else other_heads
        bucket.setdefault(head, []).append(w[len(head):])

    def joined(heads: dict[str, list[str]]) -> str:
        return "|".join(
            java(h + ("(?:" + "|".join(rest) + ")" if len(rest) > 1 else rest[0]) if h
                 else "(?:" + "|".join(rest) + ")") for h, rest in heads.items())
    parts = []
    if ascii_heads:
        flag = "(?iu:" if any(not c.isascii() for r in ascii_heads.values() for x in r for c in x) else "(?i:"
        firsts = "".join(sorted({re.escape(h[-1]) for h in ascii_heads}))
        parts.append(("(?i)" if ignore_case else "") + f"(?=[{firsts}])(?-i:" + (flag if ignore_case else "(?:") + joined(ascii_heads) + "))")
    unled = {"": other_heads.pop("")} if "" in other_heads else {}
    for heads, guard in ((other_heads, "(?=[^\\x00-\\x7f])"), (unled, "")):
        if heads:
            parts.append(guard + ("(?iu:" if ignore_case else "(?:") + joined(heads) + ")")
    return "|".join(parts)
