"""Canonical forms: texts that differ only in form get one key."""

from __future__ import annotations

import re
import sys
import unicodedata

# Characters that are punctuation wherever they stand, those that
# are punctuation unless inside a number, and those read as their plain twins.
ALWAYS = "\"“”„‟«»‹›`´¿¡!?…‽·•‘‚‛’'"
PLAIN = {"？": "?", "！": "!", "，": ",", "；": ";", "：": ":", "。": ".", "（": "(", "）": ")", "／": "/", "＋": "+", "－": "-"}

_INVISIBLE = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"} | {c: None for c in range(0xFE00, 0xFE10)}
_TABLE = _INVISIBLE | {ord(k): v for k, v in PLAIN.items()}
_DROP = re.compile("[" + re.escape(ALWAYS.replace("'", "").replace("’", "").replace("‘", "")) + "]+")
_APOSTROPHE = re.compile("['’‘‛]")
_LOOSE = re.compile(r"(?<!\d)[,;:]+|[,;:]+(?!\d)|(?<![^\W_])[.]+|[.]+(?![^\W_])|(?<![^\W_])[–—―]+|[–—―]+(?![^\W_])")
_SPACE = re.compile(r"\s+")
_TIGHT = re.compile(r" ?([/+=<>*|&%()\[\]{}^~\\]) ?")
_BULLET = re.compile(r"\s*[-*>•]\s+")
_WRAPS = {"(": ")", "[": "]", "*": "*", "_": "_"}
_ENTRY = re.compile(r"\s*[^\W\d_]+(?:[ \t\r\n'’-]+[^\W\d_]+){0,4}\s*:(?!//)")
SEPARATORS = (";", "|", "/", "\n")


def _bare(s: str) -> str:
    """The text without what is put around the whole of it: a list or quote mark before it, a pair of brackets or stars."""
    while True:
        s = s.strip()
        if len(s) > 1 and _WRAPS.get(s[0]) == s[-1] and not ({s[0], s[-1]} & set(s[1:-1])):
            s = s[1:-1]
        elif m := _BULLET.match(s):
            s = s[m.end() :]
        else:
            return s


def _fragment(s: str) -> str:
    s = _SPACE.sub(" ", s)
    while (t := _LOOSE.sub(" ", s)) != s:  # what stands beside dropped punctuation is loose too
        s = t
    return _SPACE.sub(" ", _TIGHT.sub(r"\1", _SPACE.sub(" ", s))).strip()


def _entries(s: str) -> list[str] | None:
    """The entries of a text written as ``field: value`` entries; None for any other text."""
    best: list[str] = []
    for sep in SEPARATORS:
        if sep not in s:
            continue
        found: list[str] = []
        for piece in s.split(sep):
            if _ENTRY.match(piece):
                found.append(piece)
            elif found:
                found[-1] += sep + piece
            elif piece.strip():
                found = []
                break
        if len(found) > max(1, len(best)):
            best = found
    return best or None


def question_key(text: str | None) -> str | None:
    """The text without what is mere form.

    Whitespace, invisible characters, letter case and punctuation are levelled,
    ``field: value`` entries are put in order, and marks that stand before or
    around the whole text (as in ``- text``, ``> text``, ``(text)``, ``*text*``) go.
    Signs, operators and brackets within it and punctuation inside numbers,
    dates and codes stay. Null stays null; an
    empty or blank text has the key ''.
    """
    if text is None:
        return None
    s = unicodedata.normalize("NFC", text.translate(_TABLE)).casefold()
    s = _bare(_APOSTROPHE.sub("", _DROP.sub(" ", s)))
    entries = _entries(s)
    if entries is None:
        return _fragment(s)
    out = []
    for e in entries:
        field, _, value = e.partition(":")
        out.append(f"{_fragment(field)}: {_fragment(value)}")
    return "\x1f".join(sorted(out))


_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<text>[a-zA-Z]?'(?:[^']|'')*')
    |"(?P<q1>(?:[^"]|"")+)"|`(?P<q2>[^`]+)`|\[(?P<q3>[A-Za-z_][\w ]*)\]
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<word>[^\W\d][\w$]*)
    |(?P<sign><>|!=|<=|>=|\|\||::|->>|->|\#>>|\#>|:=|=>|.)""",
    re.X | re.S,
)
# Words that end a select list or a condition at their own level.
_ENDS_LIST = {"from", "where", "group", "having", "order", "limit", "offset", "fetch", "union", "intersect", "except", "window", "into"}
_ENDS_CONDITION = _ENDS_LIST | {"join", "inner", "left", "right", "full", "cross", "natural", "when", "then", "else", "end", "qualify", "on", "using"}
_OPENS_CONDITION = {"where", "having", "on", "qualify"}


# Words after which a name in brackets can stand.
_BEFORE_NAME = _ENDS_CONDITION | {"select", "distinct", "all", "as", "by", "and", "or", "not", "in", "like", "is", "between", "update", "delete", "insert", "table", "set", "asc", "desc", "case"}
_SET_WORDS = {"union", "intersect", "except"}
_COMPARES = {"in", "=", "<>", "!=", "<", ">", "<=", ">=", "any", "all", "some"}


def _tokens(sql: str) -> list[str]:
    """Words, signs, numbers and literals; ``[i]`` right after a name or a closing bracket is a subscript and keeps its brackets."""
    out: list[str] = []
    operand = False  # whether the token before, if it touches, can have a subscript
    for m in _TOKEN.finditer(sql.translate(_INVISIBLE)):
        kind = m.lastgroup
        if kind is None:
            operand = False
            continue
        t = m[kind] if kind == "text" else m[kind].casefold()
        if kind == "q3" and operand:
            out += ["[", t, "]"]
        else:
            out.append(t)
        operand = kind in ("q1", "q2", "q3") or kind == "word" and t not in _BEFORE_NAME or t in (")", "]")
    return out


def _nest(tokens: list[str]) -> list | None:
    """Nested lists at parentheses and CASE ... END; None where these don't match."""
    stack: list[list] = [[]]
    closes: list[str] = []
    for t in tokens:
        if t in ("(", "case"):
            stack.append([t])
            closes.append(")" if t == "(" else "end")
        elif closes and t == closes[-1]:
            group = stack.pop()
            group.append(t)
            stack[-1].append(group)
            closes.pop()
        elif t == ")":
            return None
        else:
            stack[-1].append(t)
    return stack[0] if not closes else None


def _split(items: list, at: str) -> list[list]:
    parts: list[list] = [[]]
    for x in items:
        if x == at:
            parts.append([])
        else:
            parts[-1].append(x)
    return parts


def _condition(items: list) -> str:
    """OR-ed parts as they stand, each with its AND-ed conditions in order."""
    alternatives = []
    for part in _split(items, "or"):
        terms: list[list] = [[]]
        open_between = 0
        for x in part:
            if x == "between":
                open_between += 1
            if x == "and" and not open_between:
                terms.append([])
                continue
            if x == "and":
                open_between -= 1
            terms[-1].append(x)
        alternatives.append(" and ".join(sorted(_render(t) for t in terms)))
    return " or ".join(alternatives)


def _ordinals(items: list) -> bool:
    """Whether ORDER BY or GROUP BY name a column by its number."""
    for i, x in enumerate(items):
        if x == "by" and i and items[i - 1] in ("order", "group"):
            rest = items[i + 1 :]
            stop = next((k for k, y in enumerate(rest) if isinstance(y, str) and y in _ENDS_LIST), len(rest))
            if any(p and isinstance(p[0], str) and p[0].isdigit() for p in _split(rest[:stop], ",")):
                return True
    return False


def _names_follow(items: list, i: int) -> bool:
    """Whether what stands at ``i`` gives its columns, in order, to something else: a list of names, the values compared to it, or a table."""
    listed = lambda k: 0 <= k < len(items) and isinstance(items[k], list) and items[k][0] == "("
    k = i + 1 + (i + 1 < len(items) and items[i + 1] == "as")
    if k < len(items) and isinstance(items[k], str) and items[k].isidentifier() and items[k] not in _BEFORE_NAME and listed(k + 1):
        return True  # (select ..) as t (a, b)
    if items[i - 1 : i] == ["as"] and listed(i - 2):
        return True  # with t (a, b) as (select ..)
    return i > 0 and isinstance(items[i - 1], str) and items[i - 1] in _COMPARES


def _render(items: list, fixed: bool = False) -> str:
    """The text of items; the order of a select list stays if something depends on it (``fixed``, set operations, ordinals)."""
    out: list[str] = []
    united = any(isinstance(x, str) and x in _SET_WORDS for x in items)
    fixed = fixed or united or _ordinals(items) or items[:1] in (["insert"], ["create"])
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, list):
            inner = x[1:-1]
            if x[0] == "(" and not (inner and inner[0] in ("select", "with")) and ("and" in inner or "or" in inner):
                out.append("( " + _condition(inner) + " )")
            else:
                out.append(f"{x[0]} {_render(inner, united or _names_follow(items, i))} {x[-1]}")
            i += 1
            continue
        out.append(x)
        i += 1
        if x == "select":
            while i < len(items) and items[i] in ("distinct", "all"):
                out.append(items[i])
                i += 1
            if i < len(items) and items[i] == "on":  # distinct on (...)
                out += ["on", _render([items[i + 1]]) if i + 1 < len(items) else ""]
                i += 2
            j = i
            while j < len(items) and not (isinstance(items[j], str) and items[j] in _ENDS_LIST):
                j += 1
            parts = [_render(p) for p in _split(items[i:j], ",")]
            out.append(" , ".join(parts if fixed else sorted(parts)))
            i = j
        elif x in _OPENS_CONDITION or x == "when":
            j = i
            while j < len(items) and not (isinstance(items[j], str) and items[j] in _ENDS_CONDITION):
                j += 1
            out.append(_condition(items[i:j]))
            i = j
    return " ".join(out)


def statement_key(sql: str | None) -> str | None:
    """A statement without what is mere form.

    Besides whitespace, letter case, comments and the closing semicolon, the
    order of select-list items and of AND-ed conditions and the quotes around
    identifiers are levelled. The order of select-list items stays where something
    depends on it: set operations, ORDER BY or GROUP BY by number, lists of column
    names, comparisons with rows, inserts. String literals count as written; all
    other order stays. Null stays null; an empty or blank text has the key ''.
    """
    if sql is None:
        return None
    tokens = _tokens(sql)
    while tokens and tokens[-1] == ";":
        tokens.pop()
    nested = _nest(tokens)
    return " ".join(tokens) if nested is None else _render(nested)
