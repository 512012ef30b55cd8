"""Python's regular expressions in Java's dialect.

The pattern is read by Python's own parser and its tree is written anew, so that nothing
depends on what a text of one dialect happens to mean in the other. Anchors, boundaries,
classes and the dot are written out with Python's meaning.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as k
from re import _parser as reader

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of texts: what ``str.isspace`` is true for (fixed values).
_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Inner parts of classes of characters, for texts and with the flag ASCII.
_CLASSES = {"digit": (r"\p{Nd}", "0-9"), "space": (_SPACE, r"\x{9}-\x{d}\x{20}"), "word": (r"\p{L}\p{N}_", "a-zA-Z0-9_")}
_KINDS = {k.CATEGORY_DIGIT: ("digit", True), k.CATEGORY_NOT_DIGIT: ("digit", False), k.CATEGORY_SPACE: ("space", True), k.CATEGORY_NOT_SPACE: ("space", False), k.CATEGORY_WORD: ("word", True), k.CATEGORY_NOT_WORD: ("word", False)}


class Unwritable(ValueError):
    """Java has no pattern with this meaning."""


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, tested: set[int]):
        self.tested, self.open = tested, set()  # groups that conditions ask for, and those seen so far
        self.loose, self.within = set(), 0  # groups inside of loops and atoms: Java keeps what an undone round has captured

    def items(self, tree, flags: int) -> str:
        return "".join(self.item(op, value, flags) for op, value in tree)

    def inner(self, name: str, flags: int) -> str:
        return _CLASSES[name][bool(flags & re.ASCII)]

    def item(self, op, value, flags: int) -> str:
        return getattr(self, "on_" + str(op).lower())(value, flags)

    def on_literal(self, code, flags):
        return _char(code)

    def on_not_literal(self, code, flags):
        return f"[^{_char(code)}]"

    def on_any(self, _, flags):
        return "(?s:.)" if flags & re.DOTALL else r"[^\x{a}]"

    def on_in(self, members, flags):
        negated = bool(members) and members[0][0] is k.NEGATE
        plain, without = "", []  # what a class lists, and classes of which the complement is meant
        for op, value in members[negated:]:
            if op is k.LITERAL:
                plain += _char(value)
            elif op is k.RANGE:
                plain += f"{_char(value[0])}-{_char(value[1])}"
            else:
                name, positive = _KINDS[value]
                if positive:
                    plain += self.inner(name, flags)
                else:
                    without.append(self.inner(name, flags))
        if not negated and not plain and len(without) == 1:
            return f"[^{without[0]}]"
        if not negated:
            return f"[{plain}{''.join(f'[^{x}]' for x in without)}]"
        parts = [f"[{x}]" for x in without] + ([f"[^{plain}]"] if plain else [])
        return parts[0] if len(parts) == 1 else f"[{'&&'.join(parts)}]"

    def on_branch(self, value, flags):
        return f"(?:{'|'.join(self.items(x, flags) for x in value[1])})"

    def on_subpattern(self, value, flags):
        group, add, drop, tree = value
        inner = (flags | add) & ~drop
        text = self.items(tree, inner)
        if (inner ^ flags) & (re.IGNORECASE | re.ASCII):
            text = f"(?{_case(inner)}:{text})"
        if group is None:
            return f"(?:{text})"
        self.open.add(group)
        if self.within:
            self.loose.add(group)
        return f"(?<g{group}>{text}{f'(?<s{group}>)' if group in self.tested else ''})"

    def repeat(self, value, flags, kind):
        low, high, tree = value
        if high > 1 and tree.getwidth()[0] == 0:
            raise Unwritable("a loop with empty rounds ends otherwise in Java")
        most = "" if high is k.MAXREPEAT else str(int(high))
        return f"(?:{self.inside(tree, flags)}){{{int(low)},{most}}}{kind}"

    def inside(self, tree, flags):
        self.within += 1
        text = self.items(tree, flags)
        self.within -= 1
        return text

    def referred(self, group):
        """Whether the group can be set here."""
        if group in self.loose:
            raise Unwritable("a reference to a group of a loop")
        return group in self.open

    def on_max_repeat(self, value, flags):
        return self.repeat(value, flags, "")

    def on_min_repeat(self, value, flags):
        return self.repeat(value, flags, "?")

    def on_possessive_repeat(self, value, flags):
        return self.repeat(value, flags, "+")

    def on_atomic_group(self, tree, flags):
        return f"(?>{self.inside(tree, flags)})"

    def on_groupref(self, group, flags):
        return f"\\k<g{group}>" if self.referred(group) else "(?!)"  # a group that comes later isn't set

    def on_groupref_exists(self, value, flags):
        """A mark without text at the group's end tells whether it is set."""
        group, yes, no = value
        other = self.items(no, flags) if no is not None else ""
        if not self.referred(group):
            return f"(?:{other})"
        return f"(?:\\k<s{group}>{self.items(yes, flags)}|(?!\\k<s{group}>){other})"

    def on_assert(self, value, flags):
        return f"(?{'=' if value[0] > 0 else '<='}{self.items(value[1], flags)})"

    def on_assert_not(self, value, flags):
        known = set(self.open)
        text = self.items(value[1], flags)
        self.open = known  # its groups are never set beyond it
        return f"(?{'!' if value[0] > 0 else '<!'}{text})"

    def on_failure(self, _, flags):
        return "(?!)"

    def on_at(self, where, flags):
        many, word = flags & re.MULTILINE, f"[{self.inner('word', flags)}]"
        return {
            k.AT_BEGINNING: r"(?<![^\x{a}])" if many else r"\A",
            k.AT_BEGINNING_STRING: r"\A",
            k.AT_END: r"(?![^\x{a}])" if many else r"(?=\x{a}?\z)",
            k.AT_END_STRING: r"\z",
            k.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            k.AT_NON_BOUNDARY: rf"(?!\A\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word}))",
        }[where]


def _case(flags: int) -> str:
    if not flags & re.IGNORECASE:
        return "-iu"
    return "i-u" if flags & re.ASCII else "iu"


def _conditions(tree) -> set[int]:
    """Groups that conditions in the tree ask for."""
    found: set[int] = set()
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, reader.SubPattern):
            x = x.data
        if isinstance(x, tuple) and len(x) == 2 and x[0] is k.GROUPREF_EXISTS:
            found.add(x[1][0])
        if isinstance(x, (tuple, list)):
            todo.extend(x)
    return found


def java_regex(pattern: str, ignore_case: bool = False) -> str | None:
    """A pattern of Python's dialect in Java's, with the same hits as ``re.search``; null if Java can't say it.

    Not sayable are loops whose rounds may be empty and references to groups inside of loops,
    which Java settles otherwise. Raises ``re.error`` if Python can't read the pattern.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        flags = re.compile(pattern, re.IGNORECASE if ignore_case else 0).flags
        tree = reader.parse(pattern, flags & ~re.UNICODE)
    try:
        return f"(?{_case(flags)}){_Writer(_conditions(tree)).items(tree, flags)}"
    except Unwritable:
        return None


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether ``re.search`` finds the pattern in a text; false for patterns that Python can't read, null for null.

    Spark's own expression where the pattern can be written in Java's dialect, else Python's
    over Arrow batches.
    """
    try:
        regex = java_regex(pattern, ignore_case)
    except (re.error, OverflowError, RecursionError):
        return F.when(text.isNotNull(), F.lit(False))
    if regex is not None:
        return text.rlike(regex)
    flags = re.IGNORECASE if ignore_case else 0

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        search = re.compile(pattern, flags).search
        return values.map(lambda x: None if x is None else search(x) is not None).astype("object")

    return found(text)
