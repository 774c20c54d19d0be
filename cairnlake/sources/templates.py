"""URL and header templates of chunk endpoints, checked when they are made.

`{base}` base URL, `{path}` the usual `chunks/<2 digits>/<62 digits>.cnk`, `{2hex}` or `{prefix}` the first two digits, `{62hex}`
the others, `{id}` or `{hex}` all of them, `{env:NAME}` an environment variable, read when the template is made.
"""

from __future__ import annotations

import os
import re

from ..functions.hashing import parse_id

_NAMES = ("base", "path", "2hex", "62hex", "id", "hex", "prefix")


class TemplateError(ValueError):
    pass


def chunk_path(chunk_id: str) -> str:
    parse_id(chunk_id)
    return f"chunks/{chunk_id[:2]}/{chunk_id[2:]}.cnk"


class Template:
    def __init__(self, text: str, env: dict[str, str] | None = None):
        env = os.environ if env is None else env
        self.parts: list[tuple[bool, str]] = []
        at = 0
        while at < len(text):
            open_ = text.find("{", at)
            if open_ < 0:
                self.parts.append((False, text[at:]))
                break
            if open_ > at:
                self.parts.append((False, text[at:open_]))
            close = text.find("}", open_)
            if close < 0:
                raise TemplateError(f"unclosed brace in {text!r}")
            name = text[open_ + 1 : close]
            if name.startswith("env:"):
                if name[4:] not in env or not name[4:]:
                    raise TemplateError(f"environment variable {name[4:]!r} isn't set")
                self.parts.append((False, env[name[4:]]))
            elif name in _NAMES:
                self.parts.append((True, name))
            else:
                raise TemplateError(f"unknown placeholder {name!r}")
            at = close + 1

    def __call__(self, base: str, chunk_id: str) -> str:
        values = {"base": base.rstrip("/"), "path": chunk_path(chunk_id), "2hex": chunk_id[:2], "prefix": chunk_id[:2], "62hex": chunk_id[2:], "id": chunk_id, "hex": chunk_id}
        return "".join(values[x] if named else x for named, x in self.parts)


def header(text: str) -> tuple[str, str]:
    """`Name: value`."""
    name, colon, value = text.partition(":")
    if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name.strip()):
        raise TemplateError(f"header {text!r}")
    return name.strip(), value.strip()


def file_path(url: str) -> str | None:
    """The path of `file:///p`, `file://localhost/p`, `file:/p` or a plain path; None for other schemes; ValueError for other hosts."""
    if not url.startswith("file:"):
        return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", url) else url
    rest = url[len("file:") :]
    if rest.startswith("//"):
        host, slash, path = rest[2:].partition("/")
        if host not in ("", "localhost") or not slash:
            raise ValueError(f"file URL with host {host!r}")
        return "/" + path
    if not rest.startswith("/"):
        raise ValueError(f"file URL {url!r}")
    return rest
