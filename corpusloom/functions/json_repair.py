"""Repair of broken JSON as a column: a tokenizer by regular expression, and a stack automaton folded over its tokens.

The fold keeps the stack of open brackets, what is expected next, and edits of tokens where the text
departs from JSON; well-formed parts cost no edit. What is missing where a text was cut off is closed or
empty: an open string ends, a key without a value has the empty text, a comma with nothing behind it goes, and
open brackets are closed. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive groups: they keep Java's matcher from recursing in long strings.
#: A quote ends a string if what follows could follow a string, or if nothing does.
_ENDS = r"(?=\s*+(?:[,:}\]\x22'\u201c]|//|/\*|\z))"
_STRINGS = [rf"{opened}(?>[^{closed}\\]++|\\(?s:.)|{closed}(?!{_ENDS}))*+(?:{closed}|\\?\z)" for opened, closed in (('"', '"'), ("'", "'"), ("\u201c", "\u201d"))]
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
#: A word, number or several words; a colon only in what looks like an address.
_BARE = r"[^\s{}\[\]:,\x22'\u201c`](?>[^{}\[\]:,\x22\n`/]|://|/(?![/*]))*+"
_TOKEN = "|".join([_COMMENT, r"[{}\[\]:,]", *_STRINGS, _BARE])
_NUMBER = r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?"
#: Python's and others' names of what JSON calls true, false and null.
_LITERALS = {"true": ("true", "True", "TRUE"), "false": ("false", "False", "FALSE"), "null": ("null", "None", "NULL", "NaN", "nan", "undefined", "Infinity", "-Infinity")}

_STATE = "struct<stack:array<string>,wants:string,comma:int,held:string,stop:int,edits:array<struct<i:int,kind:string,put:string>>>"
#: What an edit does with its token: leave it out, write it as a value or as a key behind put, or write put in its place.
_DROP, _VALUE, _KEY, _PUT = "drop", "value", "key", "put"


def _body(token: Column) -> Column:
    """What is between a string token's quotes, as JSON writes it."""
    first, last = F.left(token, F.lit(1)), F.right(token, F.lit(1))
    closed = F.when(first == "\u201c", "\u201d").otherwise(first)
    before = F.substring(token, F.lit(1), F.length(token) - 1)
    slashes = F.length(before) - F.length(F.rtrim(before, F.lit("\\")))
    whole = (F.length(token) > 1) & (last == closed) & (slashes % 2 == 0)
    # of a string that was cut off, half an escape goes
    cut = F.regexp_replace(F.substring(token, F.lit(2), F.length(token) - 1), r"(?<!\\)((?:\\\\)*+)\\(?:u[0-9a-fA-F]{0,3}+)?\z", "$1")
    body = F.when(whole, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(cut)
    odd = r"(?<!\\)((?:\\\\)*+)"  # in front of a character: it is not escaped
    body = F.regexp_replace(body, odd + r"\\'", "$1'")
    body = F.regexp_replace(body, odd + r"\x22", r'$1\\"')
    body = F.regexp_replace(body, odd + r"\\(?![\x22\\/bfnrt]|u[0-9a-fA-F]{4})", r"$1\\\\")
    for raw, name in (("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        body = F.replace(body, F.lit(raw), F.lit(name))
    return F.regexp_replace(body, r"[\x00-\x1f]", " ")


def _quoted(text: Column) -> Column:
    """A bare word as a JSON string."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"\x22", r'\\"'), r"[\x00-\x1f]", " "), F.lit('"'))


def _is_string(token: Column) -> Column:
    return F.left(token, F.lit(1)).isin('"', "'", "\u201c")


def _as_key(token: Column) -> Column:
    return F.when(_is_string(token), F.concat(F.lit('"'), _body(token), F.lit('"'))).otherwise(_quoted(F.rtrim(token, F.lit(" \t\r"))))


def _as_value(token: Column) -> Column:
    bare = F.rtrim(token, F.lit(" \t\r"))
    literal = reduce(lambda c, kv: c.when(bare.isin(*kv[1]), kv[0]), _LITERALS.items(), F.when(F.lit(False), ""))
    number = F.regexp_replace(bare, r"(?<=\d)[.eE+-]++\z", "")
    plain = F.when(token.isin("{", "}", "[", "]", ":", ","), token).when(_is_string(token), F.concat(F.lit('"'), _body(token), F.lit('"')))
    return F.coalesce(plain, literal, F.when(number.rlike(rf"\A{_NUMBER}\z"), number), _quoted(bare))


def _closers(opened: Column) -> Column:
    """Closing brackets of a stack, the innermost first."""
    return F.array_join(F.transform(F.reverse(opened), lambda o: F.when(o == "{", "}").otherwise("]")), "")


def _with(c: Column, then) -> Column:
    """then(c), c computed once."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def _missing(wants: Column, top: Column) -> Column:
    """What has to stand before a bracket may close, or a comma follow."""
    return F.when(wants == ":", ':""').when((wants == "value") & (top == "{"), '""').otherwise("")


def _step(s: Column, x: Column) -> Column:
    """The state after a token x (t, i): one of s wants key, :, value or , next."""
    t, i, wants = x["t"], x["i"].cast("int"), s["wants"]
    top = F.coalesce(F.element_at(s["stack"], -1), F.lit(""))
    after_value = F.lit(",")
    inside = lambda opened: F.when(opened == "{", "key").otherwise("value")
    none = F.array().cast("array<struct<i:int,kind:string,put:string>>")

    def state(stack=None, wants=None, comma=None, held=None, stop=None, edits=None) -> Column:
        new = {"stack": stack, "wants": wants, "comma": comma, "held": held, "stop": stop, "edits": edits}
        return F.struct(*[(s[n] if v is None else v).alias(n) for n, v in new.items()]).cast(_STATE)

    def edit(kind: str, put: Column | str = "") -> Column:
        return F.array(F.struct(i.alias("i"), F.lit(kind).alias("kind"), (F.lit(put) if isinstance(put, str) else put).alias("put")))

    def held_comma(tail: str) -> Column:
        """The edit of the comma before this token: it stays (tail is a comma) or goes, behind what was missing before it."""
        text = F.concat(s["held"], F.lit(tail))
        return F.when((s["comma"] >= 0) & (text != ","), F.array(F.struct(s["comma"].alias("i"), F.lit(_PUT).alias("kind"), text.alias("put")))).otherwise(none)

    def taken(wants: Column, mine: Column, stack: Column | None = None) -> Column:
        return state(stack=stack, wants=wants, comma=F.lit(-1), held=F.lit(""), edits=F.concat(s["edits"], held_comma(","), mine))

    dropped = state(edits=F.concat(s["edits"], edit(_DROP)))
    put = F.when(wants == ":", ":").when(wants == ",", ",").otherwise("")
    in_front = F.when(put == "", none).otherwise(edit(_VALUE, put))
    opening = F.when((wants == "key") | ((wants == ",") & (top == "{")), dropped).otherwise(taken(inside(t), in_front, F.concat(s["stack"], F.array(t))))

    opener = F.when(t == "}", "{").otherwise("[")

    def close(depth: Column) -> Column:
        left = F.size(s["stack"]) - depth
        more = F.concat(_missing(wants, top), _closers(F.slice(s["stack"], left + 2, depth - 1)))
        mine = F.when(more == "", none).otherwise(edit(_VALUE, more))
        return state(
            stack=F.slice(s["stack"], F.lit(1), left), wants=after_value, comma=F.lit(-1), held=F.lit(""),
            stop=F.when(left == 0, i + 1).otherwise(s["stop"]), edits=F.concat(s["edits"], held_comma(""), mine),
        )

    closing = _with(F.array_position(F.reverse(s["stack"]), opener).cast("int"), lambda depth: F.when(depth == 0, dropped).otherwise(close(depth)))
    colon = F.when(wants == ":", state(wants=F.lit("value"))).otherwise(dropped)
    comma_ok = (wants == ",") | (wants == ":") | ((wants == "value") & (top == "{"))
    comma = F.when(comma_ok, state(wants=inside(top), comma=i, held=_missing(wants, top))).otherwise(dropped)
    bare = ~_is_string(t)
    as_key = taken(F.lit(":"), F.when(wants == ",", edit(_KEY, ",")).when(bare, edit(_KEY)).otherwise(none))
    word = F.when((wants == "key") | ((wants == ",") & (top == "{")), as_key).otherwise(taken(after_value, in_front))
    return F.when(s["stop"] >= 0, s).when(t.isin("{", "["), opening).when(t.isin("}", "]"), closing).when(t == ":", colon).when(t == ",", comma).otherwise(word)


def repair_json(text: Column) -> Column:
    """The first JSON object or list of a text, as JSON; null if it has no opening bracket.

    What stands before the first bracket and behind the one that closes it is left out, as are comments. Strings in single
    or curly quotes, bare words, keys without quotes, line breaks and unescaped quotes in strings, and Python's literals are
    written as JSON has them; control characters in strings become spaces. Missing commas and colons are put in, repeated
    ones and brackets that close nothing go. The result is JSON, whatever the text; keys may repeat if they did.
    """
    start = F.least(*[F.when(F.locate(b, text) > 0, F.locate(b, text)) for b in "{["])
    found = F.regexp_extract_all(F.substring(text, start, F.length(text)), F.lit(_TOKEN), F.lit(0))
    tokens = F.filter(found, lambda t: ~t.startswith("//") & ~t.startswith("/*"))
    # lambdas see the tokens as a variable, not the text: its columns' names could be taken for aliases beside it
    return F.when(start.isNotNull(), _with(tokens, _folded))


def _folded(tokens: Column) -> Column:
    """The JSON of tokens, the first of which opens."""
    rows = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    first = F.get(tokens, F.lit(0))
    begin = F.struct(F.array(first).alias("stack"), F.when(first == "{", "key").otherwise("value").alias("wants"), F.lit(-1).alias("comma"), F.lit("").alias("held"), F.lit(-1).alias("stop"), F.array().alias("edits")).cast(_STATE)

    def written(s: Column) -> Column:
        left_over = F.when(s["comma"] >= 0, F.array(F.struct(s["comma"].alias("i"), F.lit(_PUT).alias("kind"), s["held"].alias("put")))).otherwise(F.array().cast("array<struct<i:int,kind:string,put:string>>"))
        edits = F.map_from_entries(F.transform(F.concat(s["edits"], left_over), lambda e: F.struct(e["i"], F.struct(e["kind"], e["put"]))))
        kept = F.when(s["stop"] >= 0, F.slice(tokens, F.lit(1), F.greatest(s["stop"], F.lit(0)))).otherwise(tokens)

        def one(t: Column, e: Column) -> Column:
            kind = e["kind"]
            return F.when(kind.isNull(), _as_value(t)).when(kind == _DROP, "").when(kind == _PUT, e["put"]).when(kind == _KEY, F.concat(e["put"], _as_key(t))).otherwise(F.concat(e["put"], _as_value(t)))

        body = _with(edits, lambda m: F.array_join(F.transform(kept, lambda t, i: _with(F.try_element_at(m, i), lambda e: one(t, e))), ""))
        top = F.coalesce(F.element_at(s["stack"], -1), F.lit(""))
        end = F.when(s["stop"] >= 0, "").otherwise(F.concat(F.when(s["comma"] >= 0, "").otherwise(_missing(s["wants"], top)), _closers(s["stack"])))
        return F.concat(body, end)

    return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), begin, _step, written)
