"""A strict subset of YAML for configuration: two-space blocks, lists, scalars. Anything else is an error with its line."""

from __future__ import annotations

#: First characters of syntax outside the subset.
UNSUPPORTED = "&*!|>{[%@`"


def parse(text: str) -> dict | list:
    rows = []
    for n, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        body = raw.strip()
        if "\t" in raw:
            raise ValueError(f"line {n}: tab")
        if not body or body.startswith("#"):
            continue
        if body.startswith(("---", "...")):
            raise ValueError(f"line {n}: several documents")
        indent = len(raw) - len(raw.lstrip(" "))
        if indent % 2:
            raise ValueError(f"line {n}: indent of {indent}")
        rows.append((n, indent, body))
    out, at = _block(rows, 0, 0)
    if at < len(rows):
        raise ValueError(f"line {rows[at][0]}: indentation")
    return {} if out is None else out


def _field(body: str) -> tuple[str, str] | None:
    if body[0] in "\"'":
        return None
    if body.endswith(":") and ": " not in body:
        return body[:-1].strip(), ""
    key, sep, value = body.partition(": ")
    return (key.strip(), value.strip()) if sep else None


def _scalar(text: str, n: int):
    if text == "[]":
        return []
    if text[0] == '"':
        end = text.find('"', 1)
        while end > 0 and text[end - 1] == "\\":
            end = text.find('"', end + 1)
        if end < 0 or text[end + 1 :].strip() and not text[end + 1 :].strip().startswith("#"):
            raise ValueError(f"line {n}: quote")
        return text[1:end].replace('\\"', '"').replace("\\\\", "\\")
    if text[0] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise ValueError(f"line {n}: quote")
        return text[1:-1].replace("''", "'")
    if text[0] in UNSUPPORTED:
        raise ValueError(f"line {n}: {text[0]} is not supported")
    return text.split(" #")[0].rstrip()


def _put(out: dict, key: str, value, n: int) -> None:
    if key in out:
        raise ValueError(f"line {n}: {key} twice")
    out[key] = value


def _block(rows: list, at: int, indent: int):
    out = None
    while at < len(rows):
        n, own, body = rows[at]
        if own < indent:
            break
        if own > indent:
            raise ValueError(f"line {n}: indentation")
        if body == "-" or body.startswith("- "):
            out = [] if out is None else out
            if not isinstance(out, list):
                raise ValueError(f"line {n}: list item inside a mapping")
            item = body[1:].strip()
            if not item:
                raise ValueError(f"line {n}: empty list item")
            at += 1
            pair = _field(item)
            if pair is None:
                out.append(_scalar(item, n))
                continue
            entry: dict = {}
            if pair[1]:
                _put(entry, pair[0], _scalar(pair[1], n), n)
            else:
                child, at = _block(rows, at, indent + 4)
                _put(entry, pair[0], {} if child is None else child, n)
            rest, at = _block(rows, at, indent + 2)
            if rest is not None:
                if not isinstance(rest, dict):
                    raise ValueError(f"line {n}: expected keys")
                for k, v in rest.items():
                    _put(entry, k, v, n)
            out.append(entry)
            continue
        pair = _field(body)
        if pair is None:
            raise ValueError(f"line {n}: neither key nor list item")
        out = {} if out is None else out
        if not isinstance(out, dict):
            raise ValueError(f"line {n}: key inside a list")
        at += 1
        if pair[1]:
            _put(out, pair[0], _scalar(pair[1], n), n)
        else:
            child, at = _block(rows, at, indent + 2)
            _put(out, pair[0], {} if child is None else child, n)
    return out, at


def quote(value: str) -> str:
    plain = value and value == value.strip() and value[0] not in UNSUPPORTED + "-?\"'#" and not any(x in value for x in (": ", " #", "\n")) and not value.endswith(":")
    return value if plain and value not in ("true", "false", "null", "~", "[]") else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def render(doc: dict, indent: int = 0) -> str:
    """Text that parse reads back; empty members are left out, empty lists are explicit."""
    out = []
    for key, value in doc.items():
        pad = " " * indent
        if isinstance(value, dict):
            if value:
                out.append(f"{pad}{key}:\n{render(value, indent + 2)}")
        elif isinstance(value, list):
            if not value:
                out.append(f"{pad}{key}: []\n")
                continue
            out.append(f"{pad}{key}:\n")
            for item in value:
                if isinstance(item, dict):
                    lines = render(item, indent + 4)
                    out.append(f"{pad}  - {lines[indent + 4:]}")
                else:
                    out.append(f"{pad}  - {quote(str(item))}\n")
        elif value not in ("", None):
            text = str(value).lower() if isinstance(value, bool) else str(value)
            out.append(f"{pad}{key}: {text if isinstance(value, (bool, int)) else quote(text)}\n")
    return "".join(out)
