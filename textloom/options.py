"""Options of a scan, and parsers of their written forms; plain Python, used on the driver only."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

FORMATS = {
    "text": ("txt", "text", "plain", "plaintext", "plain-text", "plain_text", "t"),
    "markdown": ("md", "markdown", "mkd", "mdown", "m"),
    "xml": ("xml", "x"),
    "compact": ("compact", "lite", "c"),
    "auto": ("auto", "a", ""),
}
_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40, "P": 1 << 50}


@dataclass(frozen=True)
class ScanOptions:
    """What a scan keeps. Extensions are normalised to a leading dot; name filters spare directories by default."""

    include_ext: tuple[str, ...] = ()
    exclude_ext: tuple[str, ...] = ()
    include_name: str | None = None
    exclude_name: str | None = None
    exclude_dirs: tuple[str, ...] = ()
    exclude_dir_regex: str | None = None
    #: The root that exclude_dir_regex sees before an entry's directory; without it, the directory below the root alone.
    absolute_root: str | None = None
    ignore_dotfiles: bool = False
    #: Whether a dot-directory's whole subtree goes as well, or only entries whose own name begins with a dot.
    prune_dot_dirs: bool = False
    skip_git: bool = False
    skip_binary: bool = False
    #: Apply the extension and include-name filters to directories too, which prunes those that fail.
    filter_dirs: bool = False
    case_insensitive_order: bool = False

    def __post_init__(self) -> None:
        for f in ("include_ext", "exclude_ext"):
            object.__setattr__(self, f, tuple(e if e.startswith(".") else "." + e for e in getattr(self, f)))


def parse_byte_size(text: str) -> int:
    """``10M``, ``1.5K``, ``7``: binary multiples, whole bytes."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([BKMGTP]?)\s*", text, re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2].upper()])


def parse_switch(text: str) -> bool:
    """on/true/1/yes/y and off/false/0/no/n, in any case."""
    word = text.strip().lower()
    if word in ("on", "true", "1", "yes", "y"):
        return True
    if word in ("off", "false", "0", "no", "n"):
        return False
    raise ValueError(f"neither on nor off: {text!r}")


def parse_format(text: str) -> str:
    """The output format that a name or alias stands for."""
    for name, aliases in FORMATS.items():
        if text.strip().lower() in aliases:
            return name
    raise ValueError(f"unknown format: {text!r}")


def format_of_extension(path: str) -> str:
    """The format of a file by its extension; plain text if it tells nothing."""
    ext = path.rpartition(".")[2].lower() if "." in path else ""
    return {"md": "markdown", "markdown": "markdown", "xml": "xml", "lite": "compact"}.get(ext, "text")


def compressible(fmt: str) -> bool:
    return fmt in ("text", "markdown", "xml")


def parse_server_kind(text: str) -> str:
    if (word := text.strip().lower()) in ("stdio", "http"):
        return word
    raise ValueError(f"unknown server kind: {text!r}")


def csv_list(text: str) -> list[str]:
    """Comma-separated items, trimmed, without blanks, each once, in order."""
    return list(dict.fromkeys(x for x in (y.strip() for y in text.split(",")) if x))


def trim_dot_slash(path: str) -> str:
    return path.removeprefix("./")


def merge_sets(*allowed: Iterable[str]) -> set[str]:
    return set().union(*allowed)


def join_errors(errors: Iterable[Exception | None]) -> Exception | None:
    """One error for several, None for none."""
    found = [e for e in errors if e is not None]
    return ValueError("; ".join(map(str, found))) if found else None
