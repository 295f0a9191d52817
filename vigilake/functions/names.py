"""File names: extension, template, fileset patterns, suggested names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.fixed import TEMPLATE_STEPS, TOKEN_REGEX

_TOKENS = "|".join(TOKEN_REGEX)
_TOKEN = r"\{(" + _TOKENS + r")\}"
# A pattern is read as a run of: token pair, token, bracket class, single character.
_PIECES = r"(\{date\}\{time\}|\{(?:" + _TOKENS + r")\}|\[!?\]?[^\]]*\]|[\s\S])"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_type(name: Column) -> Column:
    """Lower-case last extension; ``.gz`` stays as a suffix; ``unknown`` without a dot."""
    lower = F.lower(name)
    zipped = lower.endswith(".gz")
    stem = F.when(zipped, F.regexp_replace(lower, r"\.gz$", "")).otherwise(lower)
    label = F.when(stem.contains("."), F.substring_index(stem, ".", -1)).otherwise("unknown")
    return F.when(zipped, F.concat(label, F.lit(".gz"))).otherwise(label)


def reader_for(name: Column) -> Column:
    """Which reader handles a file, by its extension inside any ``.gz``; null if none."""
    inner = F.regexp_replace(F.lower(name), r"\.gz$", "")
    chain = F
    for extension in ("csv", "parquet", "jsonl", "json", "xlsx"):
        chain = chain.when(inner.endswith("." + extension), F.lit(extension))
    return chain


def name_template(path: Column) -> Column:
    """``in/orders_2026-07-09.csv`` becomes ``orders_{date}.csv``."""
    return reduce(
        lambda text, step: F.regexp_replace(text, step[1], step[0].replace("{", r"\{")),
        TEMPLATE_STEPS,
        base_name(path),
    )


def has_token(template: Column) -> Column:
    return template.rlike(_TOKEN)


def template_pattern(template: Column) -> Column:
    """The template as a pattern: glob characters of the real name are taken literally."""
    return F.regexp_replace(template, r"([*?\[])", r"[$1]")


def suggested_stem(template: Column) -> Column:
    """``orders_{date}.csv`` becomes ``orders``; ``fileset`` when nothing is left."""
    stem = F.regexp_replace(template, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, _TOKEN, "")
    stem = F.regexp_replace(stem, r"^[^0-9a-zA-Z]+|[^0-9a-zA-Z]+$", "")
    return F.when(stem == "", "fileset").otherwise(stem)


def _class_regex(piece: str) -> str:
    body = piece[1:-1]
    negate = body.startswith("!")
    body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negate else body)
    return f"[{'^' if negate else ''}{body}]"


def pattern_regex(pattern: str) -> str:
    """Regex of a declared glob with tokens, for ``rlike`` (whole string must match)."""
    out = []
    for piece in re.findall(_PIECES, pattern):
        if piece == "{date}{time}":
            out.append(TOKEN_REGEX["date"] + "T?" + TOKEN_REGEX["time"])
        elif re.fullmatch(_TOKEN, piece):
            out.append(TOKEN_REGEX[piece[1:-1]])
        elif piece in "*?":
            out.append(".*" if piece == "*" else ".")
        elif len(piece) > 1:
            out.append(_class_regex(piece))
        else:
            out.append(piece if piece.isalnum() or ord(piece) > 127 else "\\" + piece)
    return "^(?s:" + "".join(out) + r")\z"


def literal_ends(pattern: str) -> tuple[str, str]:
    """The plain text that every name a glob with tokens matches begins with, and ends with."""
    plain = [piece if len(piece) == 1 and piece not in "*?" else None for piece in re.findall(_PIECES, pattern)]
    first = plain.index(None) if None in plain else len(plain)
    last = plain[::-1].index(None) if None in plain else len(plain)
    return "".join(plain[:first]), "".join(plain[len(plain) - last :])


def pattern_regex_col(pattern: Column) -> Column:
    """``pattern_regex`` for patterns that arrive as a column."""

    def one(piece: Column) -> Column:
        inner = piece.substr(F.lit(2), F.length(piece) - 2)
        negated = F.concat(F.lit("^"), _escape(piece.substr(F.lit(3), F.length(piece) - 3)))
        body = F.when(inner.startswith("!"), negated).otherwise(_escape(inner))
        rule = F.when(
            piece == "{date}{time}", F.lit(TOKEN_REGEX["date"] + "T?" + TOKEN_REGEX["time"]))
        for token, regex in TOKEN_REGEX.items():
            rule = rule.when(piece == "{" + token + "}", F.lit(regex))
        return (
            rule.when(piece == "*", F.lit(".*"))
            .when(piece == "?", F.lit("."))
            .when(F.length(piece) > 1, F.concat(F.lit("["), body, F.lit("]")))
            .when(piece.rlike(r"[0-9A-Za-z]|[^\x00-\x7f]"), piece)
            .otherwise(F.concat(F.lit("\\"), piece))
        )

    def _escape(text: Column) -> Column:
        return F.regexp_replace(text, r"([\\\[\]&^])", r"\\$1")

    pieces = F.regexp_extract_all(pattern, F.lit(_PIECES), F.lit(1))
    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(pieces, one), ""), F.lit(r")\z"))


def compiles(pattern: Column) -> Column:
    """False for a bracket class with a reversed range, the one glob that is no regex."""
    classes = F.regexp_extract_all(pattern, F.lit(r"(\[!?\]?[^\]]*\])"), F.lit(1))
    ranges = F.flatten(F.transform(classes, lambda c: F.regexp_extract_all(c, F.lit(r"([^\[!]-[^\]])"), F.lit(1))))
    return ~F.exists(ranges, lambda r: F.ascii(r) > F.ascii(F.substring(r, 3, 1)))
