"""Reading the structure of one JSON text: children verbatim, a value at a path, all nodes.

Runs inside vectorised functions.  Built-in readers change numbers, refuse
repeated keys and stop at a size; here every value is a slice of the text.
"""

import json
import re

_SPACE = re.compile(r"[ \t\r\n\x00]*")
_NAME = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"')
_ATOM = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?'
                   r'(?:[eE][+-]?[0-9]+)?|true|false|null')
# Kind of a JSON value by its first character.
_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null", "-": "number",
          **dict.fromkeys("0123456789", "number")}


def _refuse(name):
    raise ValueError(name)


def kind_of(text):
    return _KINDS.get(text[:1], "unknown")


def walk(text, at=0):
    """(path of segments, kind, child count, start, end) of every node, a container behind its children.

    One pass with a stack of its own, so any depth can be read.  A path is a
    list that changes while the walk goes on.
    """
    stack, path = [], []  # stack: [opening mark, start, children]
    at, want = _SPACE.match(text, at).end(), "value"
    while True:
        c = text[at:at + 1]
        if want == "value" and c and c in "{[":
            stack.append([c, at, 0])
            at, want = _SPACE.match(text, at + 1).end(), "first"
            continue
        if want == "first" and c == {"{": "}", "[": "]"}[stack[-1][0]] or want == "next" and c and c in "]}":
            mark, start, count = stack.pop()
            if c != {"{": "}", "[": "]"}[mark]:
                raise ValueError(f"{c} at {at}")
            yield path, "object" if mark == "{" else "array", count, start, at + 1
            at += 1
        elif want == "next":
            if c != ",":
                raise ValueError(f"no comma at {at}")
            at, want = _SPACE.match(text, at + 1).end(), "member"
            continue
        elif want in ("first", "member"):
            if stack[-1][0] == "{":
                name = _NAME.match(text, at)
                if not name:
                    raise ValueError(f"no key at {at}")
                path.append(json.loads(name.group()))
                at = _SPACE.match(text, name.end()).end()
                if text[at:at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at = _SPACE.match(text, at + 1).end()
            else:
                path.append(stack[-1][2])
            stack[-1][2] += 1
            want = "value"
            continue
        else:
            atom = _ATOM.match(text, at)
            if not atom:
                raise ValueError(f"no value at {at}")
            yield path, kind_of(atom.group()), None, at, atom.end()
            at = atom.end()
        # A value has ended.
        if not stack:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(f"more text at {at}")
            return
        path.pop()
        at, want = _SPACE.match(text, at).end(), "next"


def _end_of(decode, text, at):
    """Where the value that starts here ends."""
    try:
        return decode(text, at)[1]
    except RecursionError:
        pass
    depth = 0
    for mark in re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S).finditer(text, at):
        c = mark.group()
        depth += c in "[{"
        depth -= c in "]}"
        if not depth:
            return mark.end()
    raise ValueError(f"open value at {at}")


def children(text):
    """(segment, start, end) of the direct children, in order; keys as often as they occur."""
    # Numbers are only looked at, so they stay text whatever their length.
    decode = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str).raw_decode
    at = _SPACE.match(text).end()
    mark = text[at:at + 1]
    if mark not in ("{", "["):
        end = _end_of(decode, text, at)
    else:
        close, n = {"{": "}", "[": "]"}[mark], 0
        at = _SPACE.match(text, at + 1).end()
        while n or text[at:at + 1] != close:
            seg = str(n)
            if mark == "{":
                name = _NAME.match(text, at)
                if not name:
                    raise ValueError(f"no key at {at}")
                seg = json.loads(name.group())
                at = _SPACE.match(text, name.end()).end()
                if text[at:at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at = _SPACE.match(text, at + 1).end()
            end = _end_of(decode, text, at)
            yield seg, at, end
            n += 1
            at = _SPACE.match(text, end).end()
            if text[at:at + 1] == close:
                break
            if text[at:at + 1] != ",":
                raise ValueError(f"no comma at {at}")
            at = _SPACE.match(text, at + 1).end()
        end = at + 1
    if _SPACE.match(text, end).end() != len(text):
        raise ValueError(f"more text at {end}")


def value_at(text, path):
    """(value, error): the text of the value at a path of keys and indexes; None when there is none."""
    value = text.strip(" \t\r\n\x00") if path else text
    for seg in path:
        kind = kind_of(value)
        if kind != ("array" if isinstance(seg, int) else "object"):
            return None, None
        try:
            found = next((value[a:b] for name, a, b in children(value) if name == str(seg)), None)
        except ValueError as err:
            return None, str(err)
        if found is None:
            return None, None
        value = found
    return value, None


def path_text(path):
    out = ""
    for seg in path:
        out += f"[{seg}]" if isinstance(seg, int) else ("." if out else "") + seg
    return out
