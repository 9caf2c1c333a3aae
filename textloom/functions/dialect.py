"""Linear-time (RE2) regular expressions in Java's dialect, so that both read a pattern alike."""

from __future__ import annotations

import re

_W = "A-Za-z0-9_"
_BOUND = f"(?:(?<![{_W}])(?=[{_W}])|(?<=[{_W}])(?![{_W}]))"
_INSIDE = f"(?:(?<![{_W}])(?![{_W}])|(?<=[{_W}])(?=[{_W}]))"
_SPACE = r"\t\n\f\r "
_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\t ", "cntrl": r"\p{Cntrl}", "digit": "0-9", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r ", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}


def to_java(pattern: str) -> str:
    """The Java form of a pattern; ValueError for what the linear-time dialect has not (lookaround, back-references)."""
    out, i, n, multiline = ["(?d)"], 0, len(pattern), False
    in_class = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise ValueError("pattern ends with a backslash")
            e = pattern[i + 1]
            if e.isdigit() and e != "0" and not in_class:
                raise ValueError("back-references are not supported")
            if e == "Q":
                end = pattern.find("\\E", i + 2)
                end = n if end < 0 else end
                out.append(re.sub(r"([^\w\s])", r"\\\1", pattern[i + 2 : end], flags=re.ASCII))
                i = end + 2
                continue
            if e == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif e == "S":
                out.append(rf"[^{_SPACE}]")
            elif e == "b" and not in_class:
                out.append(_BOUND)
            elif e == "B" and not in_class:
                out.append(_INSIDE)
            elif e == "C":
                raise ValueError("single bytes are not supported")
            elif e == "x" and pattern[i + 2 : i + 3] != "{":
                out.append(pattern[i : i + 4])
                i += 4
                continue
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            if pattern.startswith("[:", i) and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                if m[2] not in _POSIX:
                    raise ValueError(f"unknown class {m[0]}")
                out.append(f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
                i += len(m[0])
                continue
            if c == "]":
                in_class = False
                out.append(c)
            elif c in "[&":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
            if pattern.startswith("]", i + 1):  # a bracket that comes first is itself
                out.append("\\]")
                i += 1
        elif c == "(" and pattern.startswith("(?", i):
            if re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
                raise ValueError("lookaround is not supported")
            if m := re.match(r"\(\?P?<(\w+)>", pattern[i:]):
                out.append(f"(?<{m[1].replace('_', '')}>")
                i += len(m[0])
                continue
            if m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", pattern[i:]):
                if "U" in (m[1] or "") + (m[2] or ""):
                    raise ValueError("the ungreedy flag is not supported")
                multiline |= "m" in m[1]
                out.append("(?" + m[1].replace("i", "iu") + (f"-{m[2].replace('i', 'iu')}" if m[2] else "") + m[3])
                i += len(m[0])
                continue
            raise ValueError(f"unknown group at {pattern[i : i + 6]!r}")
        elif c == "$" and not multiline:
            out.append("\\z")
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise ValueError("possessive quantifiers are not supported")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise ValueError("a class is not closed")
    return "".join(out)
