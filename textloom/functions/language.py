"""Language tags by file name, and the comment grammar of each language."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import base_name, extension

LANGUAGES = {
    "abap": "abap", "actionscript": "as", "ada": "ada", "apache": "apacheconf", "applescript": "applescript", "autohotkey": "ahk", "bash": "bash sh zsh", "bat": "bat",
    "brainfuck": "bf", "c": "c h", "clojure": "clj cljs", "cmake": "cmake", "coffeescript": "coffee", "cpp": "cc cpp cxx", "csharp": "cs", "css": "css", "dart": "dart",
    "diff": "diff", "dockerfile": "dockerfile", "emacs-lisp": "el", "erlang": "erl", "go": "go", "groovy": "groovy", "haskell": "hs", "html": "html", "ini": "ini",
    "java": "java", "javascript": "js", "json": "json", "jsx": "jsx", "kotlin": "kt kts", "latex": "tex", "less": "less", "lisp": "lisp", "lua": "lua",
    "markdown": "md markdown mkd", "objectivec": "m mm", "perl": "pl", "php": "php", "powershell": "ps1", "python": "py", "r": "r", "ruby": "rb", "rust": "rs",
    "scala": "scala", "scss": "scss", "sql": "sql", "swift": "swift", "text": "txt", "toml": "toml", "tsx": "tsx", "typescript": "ts", "vim": "vim", "vue": "vue",
    "xml": "xml", "yaml": "yml yaml",
}
BY_EXTENSION = {"." + e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}
_C = (("//",), (("/*", "*/"),))
#: (line prefixes, block delimiters) -> languages. Others have no comments.
GRAMMARS = {
    (("#",), ()): "bash sh zsh dockerfile makefile cmake groovy abap ada ahk apache applescript as powershell r ruby perl el latex python yaml toml ini",
    (('"',), ()): "vim",
    _C: "go java c cpp csharp javascript typescript ts tsx jsx rust kotlin swift dart coffeescript objectivec",
    ((), (("<!--", "-->"),)): "html xml vue",
    (("//", "#"), (("/*", "*/"),)): "php",
    (("--", ";"), ()): "scala haskell clojure lisp elixir",
    (("--",), ()): "sql",
    ((), (("/*", "*/"),)): "css less scss",
}


def language_of(path: Column) -> Column:
    """The language tag of a path; '' if unknown."""
    name = F.lower(base_name(path))
    table = F.create_map(*map(F.lit, chain.from_iterable(sorted(BY_EXTENSION.items()))))
    return (
        F.when(name == "dockerfile", "dockerfile").when(name.startswith("makefile"), "makefile").when(name == "cmakelists.txt", "cmake").when(name == "build.gradle", "groovy").when(name == "vagrantfile", "ruby")
        .otherwise(F.coalesce(F.element_at(table, F.lower(extension(path))), F.lit("")))
    )
