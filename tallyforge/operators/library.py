"""The site's own files: templates saved, hidden and deleted, phrases added to a vocabulary with its comments kept.

These are edits of small files on the driver; no Spark takes part.
"""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

import yaml

from .templates import problems

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
KEY = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


def _replace(path: Path, text: str) -> None:
    """Write a file whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(name, path)


def _path(folder: str, name: str) -> Path:
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no usable id")
    return Path(folder) / f"{name}.yaml"


def save(folder: str, template: dict) -> Path:
    """Write a template under its id; one that can't be used is refused with what is wrong."""
    wrong = problems(template)
    if wrong:
        raise ValueError("; ".join(wrong))
    path = _path(folder, template["id"])
    _replace(path, yaml.safe_dump({k: v for k, v in template.items() if k not in ("origin", "errors")}, sort_keys=False, allow_unicode=True))
    return path


def hide(folder: str, name: str, hidden: bool = True) -> None:
    """A hidden template stays on file and is left out of detection."""
    path = _path(folder, name)
    template = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    template["hidden"] = hidden
    _replace(path, yaml.safe_dump(template, sort_keys=False, allow_unicode=True))


def delete(folder: str, name: str) -> bool:
    """Remove a site's own template; whether there was one."""
    path = _path(folder, name)
    if not path.exists():
        return False
    path.unlink()
    return True


def known_phrases(data: dict, key: str, under: str | None = None) -> list[str]:
    found = data.get(key)
    if under is not None:
        found = found.get(under) if isinstance(found, dict) else None
    return [found] if isinstance(found, str) else [str(x) for x in found or []]


def _with_phrase(lines: list[str], key: str, phrase: str, under: str | None) -> list[str]:
    """The lines with an item more in the list of `key` (or of `under` within it); a list that isn't there is added."""
    item = f'"{phrase}"'
    start = next((i for i, line in enumerate(lines) if re.match(rf"{key}\s*:", line)), None)
    if start is None:
        head = [f"{key}:"] if under is None else [f"{key}:", f"  {under}:"]
        return [*lines, *head, f"{'  ' * len(head)}- {item}"]
    end = next((i for i in range(start + 1, len(lines)) if re.match(r"[^#\s]", lines[i])), len(lines))
    if under is not None:
        inner = next((i for i in range(start + 1, end) if re.match(rf"\s+{under}\s*:", lines[i])), None)
        if inner is None:
            return [*lines[:end], f"  {under}:", f"    - {item}", *lines[end:]]
        depth = len(lines[inner]) - len(lines[inner].lstrip())
        start, end = inner, next((i for i in range(inner + 1, end) if lines[i].strip() and not lines[i].lstrip().startswith("#") and len(lines[i]) - len(lines[i].lstrip()) <= depth and not lines[i].lstrip().startswith("- ")), end)
    flow = re.match(r"(.*:\s*\[)(.*)(\]\s*(?:#.*)?)$", lines[start])
    if flow:
        listed = flow[2].rstrip().rstrip(",")
        return [*lines[:start], f"{flow[1]}{listed}{', ' if listed.strip() else ''}{item}{flow[3]}", *lines[start + 1 :]]
    last = max((i for i in range(start + 1, end) if lines[i].lstrip().startswith("- ")), default=None)
    indent = re.match(r"\s*", lines[last])[0] if last is not None else "  " * (1 if under is None else 2)
    at = last + 1 if last is not None else start + 1
    return [*lines[:at], f"{indent}- {item}", *lines[at:]]


def append_phrase(path: str, key: str, phrase: str, under: str | None = None) -> bool:
    """Add a phrase to a vocabulary file, its comments kept; False if it is known already.

    An edit that would not read back as the old content and the phrase leaves the file as it is.
    """
    phrase = phrase.strip()
    if not KEY.fullmatch(key) or under is not None and not KEY.fullmatch(under):
        raise ValueError(f"{key!r} is no usable name")
    if not phrase or re.search(r'[\r\n"\\]', phrase):
        raise ValueError("a phrase is one line without quotes")
    file = Path(path)
    text = file.read_text(encoding="utf-8") if file.exists() else ""
    before = yaml.safe_load(text) or {}
    if not isinstance(before, dict):
        raise ValueError("the file is no vocabulary")
    known = known_phrases(before, key, under)
    if phrase.lower() in (k.lower() for k in known):
        return False
    out = "\n".join(_with_phrase(text.splitlines(), key, phrase, under)) + "\n"
    try:
        after = yaml.safe_load(out)
    except yaml.YAMLError as fault:
        raise ValueError("there is no safe place for the phrase") from fault
    if known_phrases(after, key, under) != [*known, phrase]:
        raise ValueError("there is no safe place for the phrase")
    _replace(file, out)
    return True
