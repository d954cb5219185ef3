"""Sigma rules compiled to boolean Columns.

A rule is compiled once on the driver. All rules then evaluate inside one projection;
an event only evaluates the rules of its own source.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.functions import expr as X
from hostwarden.schema import DETAIL_COLUMNS

# fixed values: field and category names of the rule language
FIELD_ALIASES = {
    "Image": "exe", "CommandLine": "cmdline", "ParentImage": "parent_exe", "User": "user",
    "DestinationIp": "remote_addr", "DestinationPort": "remote_port", "SourcePort": "local_port",
    "TargetFilename": "path", "ProcessName": "name",
}
CATEGORY_SOURCE = {
    "process_creation": "process", "network_connection": "network",
    "file_event": "filesystem", "resource_event": "resource",
}
SOURCES = ("process", "network", "filesystem", "resource")
_DOUBLE_FIELDS = ("cpu_pct", "threshold")


def _number_literal(value) -> str:
    """A rule literal as the text an event value would have."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "<nil>"
    if isinstance(value, float):
        if value == int(value) and abs(value) < 1e6:
            return str(int(value))
        text = repr(value)
        if 1e6 <= abs(value) < 1e21 and "e" not in text:
            digits = text.replace("-", "").replace(".0", "").replace(".", "")
            whole = str(int(abs(value)))
            mantissa = digits[0] + ("." + digits[1:].rstrip("0") if digits[1:].rstrip("0") else "")
            return ("-" if value < 0 else "") + f"{mantissa}e+{len(whole) - 1:02d}"
        return text
    return str(value)


def field_text(field: str) -> Column:
    """The event value a rule field names, as text; null when absent."""
    key = FIELD_ALIASES.get(field, field)
    if key in DETAIL_COLUMNS:
        value = X.number_text(F.col(key)) if key in _DOUBLE_FIELDS else F.col(key).cast("string")
    else:
        value = F.try_element_at(F.col("extra"), F.lit(key))
    if key.lower() in ("source", "kind"):
        value = F.coalesce(value, F.col(key.lower()))
    return value


def wildcard_regex(pattern: str) -> str:
    """``*`` pattern to a regex that takes the leftmost match of each piece and never backtracks."""
    pieces = pattern.split("*")
    out = r"(?s)\A" + _quote(pieces[0])
    out += "".join(f"(?>.*?{_quote(p)})" for p in pieces[1:] if p)
    return out if pattern.endswith("*") else out + r"\z"


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


# Constructs the rule language's regex dialect does not have but Java does.
_UNSUPPORTED = re.compile(r"\(\?[=!>]|\(\?<[=!]|\\[1-9]|\\k<|[*+?}]\+|\\[zG]")
_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}",
    "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}",
}


def java_regex(pattern: str) -> str | None:
    """A rule regex in Java form; None when the dialect rejects it."""
    if _UNSUPPORTED.search(pattern):
        return None
    translated = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m.group(1), "("), pattern)
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", translated, flags=re.I))
    except re.error:
        return None
    return "(?i)" + translated


def _match_text(actual: Column, pattern: str, modifier: str) -> Column:
    low, pat = F.lower(actual), pattern.lower()
    if modifier == "contains":
        return low.contains(pat)
    if modifier == "startswith":
        return low.startswith(pat)
    if modifier == "endswith":
        return low.endswith(pat)
    if modifier == "re":
        regex = java_regex(pat)
        return F.lit(False) if regex is None else low.rlike(regex)
    if "*" in pat:
        return F.lit(True) if pat == "*" else low.rlike(wildcard_regex(pat))
    return low == pat


def _match_value(actual: Column, expected, modifier: str) -> Column:
    if isinstance(expected, str):
        return _match_text(actual, expected, modifier)
    if isinstance(expected, list):
        texts = [_number_literal(v) for v in expected]
        plain = [t.lower() for t in texts]
        if modifier not in ("contains", "startswith", "endswith", "re") and plain and not any("*" in t for t in plain):
            return F.lower(actual).isin(plain)
        return X.any_of(_match_text(actual, t, modifier) for t in texts)
    if isinstance(expected, (int, float)) and not isinstance(expected, bool):
        return actual == _number_literal(expected)
    return F.lit(False)


def _field_map(fields: dict) -> Column:
    tests = []
    for key, expected in fields.items():
        if not isinstance(key, str):
            return F.lit(False)
        field, _, modifier = key.partition("|")
        tests.append(F.coalesce(_match_value(field_text(field), expected, modifier), F.lit(False)))
    return reduce(and_, tests) if tests else F.lit(True)


def selection(value) -> Column:
    """A selection: a map is AND over its fields, a list is OR over its maps."""
    if isinstance(value, dict):
        return _field_map(value)
    if isinstance(value, list):
        return X.any_of(_field_map(item) for item in value if isinstance(item, dict))
    return F.lit(False)


def _split_top(text: str, word: str) -> list[str]:
    """Split on a word outside parentheses."""
    parts, last = [], 0
    for m in re.finditer(re.escape(word), text):
        before = text[: m.start()]
        if before.count("(") == before.count(")"):
            parts.append(text[last : m.start()])
            last = m.end()
    return [*parts, text[last:]]


def condition(text: str, detection: dict, standard_precedence: bool = False) -> Column:
    """A condition string over named selections.

    By default a leading ``not`` negates all that follows and ``and`` splits before ``or``;
    ``standard_precedence`` gives the usual not > and > or.
    """
    text = text.strip()
    if not standard_precedence and text.startswith("not "):
        return ~condition(text[4:], detection)
    for word in ((" or ", " and ") if standard_precedence else (" and ", " or ")):
        parts = _split_top(text, word)
        if len(parts) > 1:
            cols = [condition(p, detection, standard_precedence) for p in parts]
            return reduce(and_, cols) if word == " and " else X.any_of(cols)
    if text.startswith("not "):
        return ~condition(text[4:], detection, standard_precedence)
    if text.startswith("(") and text.endswith(")"):
        return condition(text[1:-1], detection, standard_precedence)
    for quantifier in ("1 of ", "all of "):
        if text.startswith(quantifier):
            prefix = text[len(quantifier):].removesuffix("*")
            cols = [
                selection(v) for k, v in detection.items()
                if isinstance(k, str) and k != "condition" and k.startswith(prefix)
            ]
            if quantifier == "1 of ":
                return X.any_of(cols)
            return reduce(and_, cols) if cols else F.lit(False)
    return selection(detection[text]) if text in detection else F.lit(False)


def rule_source(rule: dict) -> str | None:
    """The event source a rule is limited to, or None for all."""
    return CATEGORY_SOURCE.get(rule["category"])


def match_column(rule: dict, standard_precedence: bool = False) -> Column:
    """Does the rule's detection match, regardless of source."""
    detection = rule["detection"]
    if not isinstance(detection, dict):
        return F.lit(False)
    text = detection.get("condition")
    text = text if isinstance(text, str) and text else "selection"
    return F.coalesce(condition(text, detection, standard_precedence), F.lit(False))


def rule_column(rule: dict, standard_precedence: bool = False) -> Column:
    """Source gate and detection together."""
    source, match = rule_source(rule), match_column(rule, standard_precedence)
    return match if source is None else (F.col("source") == source) & match


def bonus_of(level: str) -> float:
    return X.LEVEL_BONUS.get(level, X.OTHER_LEVEL_BONUS)


def evaluate(events: DataFrame, rules: Sequence[dict], standard_precedence: bool = False) -> DataFrame:
    """Add ``sigma_rules`` (matched titles in rule order) and ``sigma_bonus``."""
    hit_type = "array<struct<title:string,bonus:double>>"

    def hits_for(source: str | None) -> Column:
        hits = [
            F.when(
                match_column(r, standard_precedence),
                F.struct(F.lit(r["title"]).alias("title"), F.lit(bonus_of(r["level"])).alias("bonus")),
            )
            for r in rules if rule_source(r) in (None, source)
        ]
        return F.array_compact(F.array(*hits)).cast(hit_type) if hits else F.array().cast(hit_type)

    column = hits_for(None)
    for source in SOURCES:
        column = F.when(F.col("source") == source, hits_for(source)).otherwise(column)
    return (
        events.withColumn("_sigma_hits", column)
        .withColumn("sigma_rules", F.col("_sigma_hits.title"))
        .withColumn("sigma_bonus", F.aggregate("_sigma_hits", F.lit(0.0), lambda acc, h: acc + h["bonus"]))
        .drop("_sigma_hits")
    )


def rule_hits(evaluated: DataFrame) -> DataFrame:
    """Events per matched rule title."""
    return evaluated.select(F.explode("sigma_rules").alias("title")).groupBy("title").agg(
        F.count(F.lit(1)).alias("hits")
    )
