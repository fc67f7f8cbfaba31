"""The shape of JSON: where a text stops being JSON, and which nodes have another type than a schema says.

A text's first fault is found by folding its tokens through an automaton whose
state is a mode, the open brackets and the last comma or quote; lines and columns
are those of the usual decoders.  Types are checked by walking a parsed value
beside a schema: lists by their elements, objects by their keys, each node with
its path.  Both stay inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.operators.spans import let

ISSUE = "array<struct<code:string,path:string>>"

# --- faults ----------------------------------------------------------------------------

#: Tokens, longest meaning first: good and bad escapes, numbers, names, spaces, line breaks and tabs, text, single characters.
TOKEN = r"""(?s)\\u[0-9a-fA-F]{4}|\\["\\/bfnrt]|\\u|-?Infinity|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null|NaN| ++|[^\x00-\x20\[\]{}:,"\\\-0-9tfnNI]++|."""
# what may come next: a value at the top, the first or another element, the end of a value, the first or another key,
# a colon, a member's value; or inside a key or a text
TOP, FIRST, NEXT, AFTER, KEY, NEXT_KEY, COLON, MEMBER, IN_KEY, IN_TEXT = range(10)


def _moved(state: Column, token: Column) -> Column:
    """The automaton's state after a token: (pos, mode, open, mark, escape, fault)."""
    pos, mode, opened, mark = (state.getField(x) for x in ("pos", "mode", "open", "mark"))
    c = F.substring(token, 1, 1)
    top = F.substring(opened, 1, 1)
    inside = mode >= IN_KEY
    blank = token.rlike(r"^[ \t\n\r]")
    scalar = token.rlike(r"^(-?[0-9]|-?Infinity|true|false|null|NaN)")
    value = mode.isin(TOP, FIRST, NEXT, MEMBER)
    key = mode.isin(KEY, NEXT_KEY)
    closes = ((mode == FIRST) & (c == "]")) | ((mode == KEY) & (c == "}")) | ((mode == AFTER) & (((top == "a") & (c == "]")) | ((top == "o") & (c == "}"))))
    comma = (mode == AFTER) & (opened != "") & (c == ",")
    # a mode of -1 is a fault at the token, -2 one at the mark, -3 one behind the token's first character
    turn = (
        F.when(inside & (c == '"'), F.when(mode == IN_KEY, COLON).otherwise(AFTER))
        .when(inside & token.rlike(r"^[\x00-\x1f]"), -1)
        .when(inside & (token == "\\u"), -3)
        .when(inside & (token == "\\"), -1)
        .when(inside | blank, mode)
        .when(closes, AFTER)
        .when(comma, F.when(top == "a", NEXT).otherwise(NEXT_KEY))
        .when(((mode == NEXT) & (c == "]")) | ((mode == NEXT_KEY) & (c == "}")), -2)
        .when(value & (c == '"'), IN_TEXT)
        .when(value & scalar, AFTER)
        .when(value & (c == "["), FIRST)
        .when(value & (c == "{"), KEY)
        .when(key & (c == '"'), IN_KEY)
        .when((mode == COLON) & (c == ":"), MEMBER)
        .otherwise(-1)
    )

    def moved(to: Column) -> Column:
        return F.struct(
            (pos + F.length(token)).alias("pos"),
            F.when(to < 0, mode).otherwise(to).alias("mode"),
            F.when(~inside & closes, F.substring(opened, 2, 1 << 30)).when(~inside & value & (c == "["), F.concat(F.lit("a"), opened)).when(~inside & value & (c == "{"), F.concat(F.lit("o"), opened)).otherwise(opened).alias("open"),
            F.when(~inside & ((c == '"') | comma), pos).otherwise(mark).alias("mark"),
            (inside & (F.length(token) == 6) & F.startswith(token, F.lit("\\u"))).alias("escape"),
            F.when(to == -1, pos).when(to == -2, mark).when(to == -3, pos + 1).otherwise(F.lit(-1)).alias("fault"),
        )

    return F.when(state.getField("fault") >= 0, state).otherwise(let(turn, moved))


def _end(state: Column) -> Column:
    """The place of the fault; -1 if there is none."""
    pos, mode, mark = (state.getField(x) for x in ("pos", "mode", "mark"))
    fault = state.getField("fault")
    open_text = F.when(state.getField("escape"), pos - 5).otherwise(mark)  # an escape needs a character behind it
    # a backslash that ends the text leaves the text open
    return (
        F.when((mode >= IN_KEY) & (fault < 0), open_text)
        .when((mode >= IN_KEY) & (fault == pos - 1) & state.getField("last"), mark)
        .when(fault >= 0, fault)
        .when((mode == AFTER) & (state.getField("open") == ""), F.lit(-1))
        .otherwise(pos)
    )


def json_fault(text: Column) -> Column:
    """(position, line, column) of the first fault of a JSON text; null if it has none.

    position counts code points from 0, line and column from 1.  NaN and Infinity
    pass, as they do in decoders; a repeated key is no fault; null has none; empty
    texts lack a value at their end.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(TOP).alias("mode"), F.lit("").alias("open"), F.lit(0).alias("mark"), F.lit(False).alias("escape"), F.lit(-1).alias("fault"))
    folded = F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), 0), start, _moved)

    def place(at: Column) -> Column:
        before = F.substr(text, F.lit(1), at)
        lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
        column = F.length(F.substring_index(before, "\n", -1)) + 1
        return F.when(at >= 0, F.struct(at.alias("position"), (lines + 1).alias("line"), column.alias("column")))

    last = F.endswith(text, F.lit("\\"))
    return let(let(folded, lambda s: _end(_with_last(s, last, F.length(text)))), place)


def _with_last(state: Column, last: Column, length: Column) -> Column:
    return F.struct(*[state.getField(x).alias(x) for x in ("mode", "open", "mark", "escape", "fault")], length.alias("pos"), last.alias("last"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value, by the engine's parser; some JSON it can't hold (repeated keys, very large values) is not.

    The parser stops behind the first value, so the text goes into a list before a
    mark that must be found: its own hash, which it can't hold.
    """
    mark = F.md5(text.cast("binary"))
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), "$", "array<variant>")
    second = F.try_variant_get(F.get(both, 1), "$", "string")
    return F.coalesce((F.size(both) == 2) & (second == mark), F.lit(False))


# --- types -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A text or a whole number; kinds are the engine's names of the types that pass."""

    kinds: str


@dataclass(frozen=True)
class Items:
    """A list, all of whose elements have one type."""

    of: "Node"


class Fields:
    """An object: keys in their order, groups that must be there and groups that may by turns, and no others."""

    def __init__(self, *groups: dict[str, "Node"]):
        self.required = {k: n for g in groups[::2] for k, n in g.items()}
        self.known = {k: n for g in groups for k, n in g.items()}


@dataclass(frozen=True)
class Nullable:
    of: "Node"


Node = Leaf | Items | Fields | Nullable
TEXT = Leaf("^STRING$")
#: Whole numbers beyond 64 bits are decimals of 19 digits or more; shorter decimals had a point.
WHOLE = Leaf(r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$")


def _wrong(path: Column) -> Column:
    return F.array(F.struct(F.lit("invalid_type").alias("code"), path.alias("path")))


def _none() -> Column:
    return F.array().cast(ISSUE)


def walk(value: Column, node: Node, path: Column) -> Column:
    """Issues (code, path) of a parsed value: nodes of another type, keys that lack or are too many."""
    if isinstance(node, Nullable):
        return F.when(F.is_variant_null(value), _none()).otherwise(walk(value, node.of, path))
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    if isinstance(node, Leaf):
        return F.when(kind.rlike(node.kinds), _none()).otherwise(_wrong(path))
    if isinstance(node, Items):
        elements = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(elements, lambda e, i: walk(e, node.of, F.concat(path, F.lit("["), i, F.lit("]"))))
        return F.when(F.startswith(kind, F.lit("ARRAY<")), F.flatten(each)).otherwise(_wrong(path))
    known = node.known

    def members(found: Column) -> Column:
        inner = lambda k: F.concat(path, F.lit(f".{k}"))
        absent = lambda k: _wrong(inner(k)) if k in node.required else _none()
        each = [F.when(F.map_contains_key(found, k), walk(F.element_at(found, F.lit(k)), n, inner(k))).otherwise(absent(k)) for k, n in known.items()]
        extra = F.array_except(F.map_keys(found), F.array(*map(F.lit, known)))
        return F.concat(*each, F.transform(extra, lambda k: F.struct(F.lit("invalid_type").alias("code"), F.concat(path, F.lit("."), k).alias("path"))))

    return F.when(F.startswith(kind, F.lit("OBJECT<")), let(F.try_variant_get(value, "$", "map<string,variant>"), members)).otherwise(_wrong(path))


def shape_issues(json_text: Column, node: Node) -> Column:
    """Issues of a JSON text's shape: invalid_json where it can't be read, else what walk() finds."""
    unreadable = F.array(F.struct(F.lit("invalid_json").alias("code"), F.lit("$").alias("path")))
    return let(F.try_parse_json(json_text), lambda v: F.when(v.isNull(), unreadable).otherwise(walk(v, node, F.lit("$"))))
