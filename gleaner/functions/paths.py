"""Paths: globs, extensions, MIME types and content types, as Columns or plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions whose files count as source code of a language.
CODE_LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell", "zsh": "shell",
}
# Extensions read as text.
TEXT_EXTENSIONS = [
    "txt", "md", "markdown", "rs", "py", "java", "js", "ts", "tsx", "jsx", "go", "c", "cpp", "cc", "h", "hpp", "json", "xml",
    "html", "htm", "css", "scss", "sass", "toml", "yaml", "yml", "sh", "bash", "zsh", "fish", "sql", "rb", "php", "swift", "kt", "kts",
    "scala", "clj", "ex", "exs", "erl", "hs", "ml", "mli", "fs", "fsx", "lua", "vim", "el", "lisp", "scm", "rkt", "asm", "s",
    "dockerfile", "makefile", "cmake", "gradle", "sbt", "cabal", "nix", "tf", "hcl",
]
# MIME types read as text.
TEXT_MIMES = [
    "text/plain", "text/markdown", "text/x-markdown", "application/x-sh", "text/x-rust", "text/x-python", "text/x-java",
    "text/javascript", "text/typescript", "text/x-go", "text/x-c", "text/x-c++", "application/json", "application/xml",
    "text/xml", "text/html", "text/css", "application/toml", "text/x-toml", "application/yaml", "text/x-yaml",
]
IMAGE_MIMES = ["image/png", "image/jpeg", "image/gif", "image/bmp", "image/webp"]
# MIME type by extension; anything else is text/plain.
MIME_BY_EXTENSION = {
    "md": "text/markdown", "markdown": "text/markdown", "rs": "text/x-rust", "py": "text/x-python", "java": "text/x-java", "js": "text/javascript",
    "mjs": "text/javascript", "ts": "text/typescript", "go": "text/x-go", "c": "text/x-c", "h": "text/x-c", "cpp": "text/x-c++", "hpp": "text/x-c++",
    "cc": "text/x-c++", "json": "application/json", "xml": "text/xml", "html": "text/html", "htm": "text/html", "css": "text/css",
    "toml": "text/x-toml", "yaml": "text/x-yaml", "yml": "text/x-yaml", "sh": "application/x-sh", "pdf": "application/pdf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp",
}


def glob_to_regex(glob: str) -> str:
    """A regular expression that matches whole paths as the glob does.

    ``**`` spans directories, ``*`` and ``?`` stay within one, ``**/`` may match nothing; a
    glob without a slash matches the last part of any path.
    """
    if "/" not in glob:
        glob = "**/" + glob
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; false for none."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_to_regex(g))
    return out


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension, empty if there is none; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def mime_of(path: Column) -> Column:
    return F.coalesce(_lookup(extension(path), MIME_BY_EXTENSION), F.lit("text/plain"))


def language_of(path: Column) -> Column:
    """The programming language of a path by its extension, else null."""
    return _lookup(extension(path), CODE_LANGUAGES)


def content_type_of(path: Column, strict_types: bool = False) -> Column:
    """``code:<language>``, ``markdown`` or ``text`` from the path.

    An extension that is not known counts as code of that name, unless ``strict_types``.
    """
    ext = extension(path)
    other = F.lit("text") if strict_types else F.when(ext != "", F.concat(F.lit("code:"), ext)).otherwise("text")
    return (
        F.when(language_of(path).isNotNull(), F.concat(F.lit("code:"), language_of(path)))
        .when(ext.isin("md", "markdown"), F.lit("markdown"))
        .otherwise(other)
    )


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is the scope or lies below it, part by part."""
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def index_name(path: Column) -> Column:
    """A short stable name for a source path: 16 hexadecimal digits."""
    return F.substring(F.sha2(path, 256), 1, 16)
