"""Configuration: nested settings from a small YAML subset (maps, lists, scalars)."""

from __future__ import annotations

from pathlib import Path


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    named = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str):
    """The value of a YAML text of indented maps, dashed lists and scalars."""
    lines = []
    for raw in text.splitlines():
        line = raw.split(" #", 1)[0].rstrip()
        if line.strip() and not line.lstrip().startswith("#") and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, indent: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                item = lines[at][1][1:].strip()
                if not item:
                    value, at = block(at + 1, lines[at + 1][0])
                elif ": " in item or item.endswith(":"):
                    lines[at] = (indent + 2, item)
                    value, at = block(at, indent + 2)
                else:
                    value, at = _scalar(item), at + 1
                out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            key, _, rest = lines[at][1].partition(":")
            if rest.strip():
                out[key.strip()], at = _scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("- ")):
                out[key.strip()], at = block(at + 1, lines[at + 1][0])
            else:
                out[key.strip()], at = None, at + 1
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load(path: str, **overrides):
    """The settings of a file; overrides replace top-level keys."""
    return parse(Path(path).read_text()) | overrides
