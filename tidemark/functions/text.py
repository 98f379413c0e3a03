"""Text of numbers, white space, grounding of quotes, and the small argument parsers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Refused


def trim_all(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value (Spark's parser alone stops at the first and ignores the rest)."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return F.coalesce((F.size(listed) == 1) & held.isNotNull(), F.lit(False))


def number_text(c: Column) -> Column:
    """Plain decimal text of a double: the shortest digits that name it, whole numbers without a point, never an exponent."""
    d = c.cast("double")
    shown = d.cast("string")
    power = F.regexp_extract(shown, "E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(shown, "^-|E.*$", "")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")  # one digit stands before the point
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(sign, F.rpad(digits, F.greatest(power + 1, F.length(digits)), F.lit("0")))
    large = F.when(F.length(digits) > power + 1, F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))).otherwise(large)
    return F.when(~shown.contains("E"), F.regexp_replace(shown, r"\.0$", "")).when(power < 0, small).otherwise(large)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def shortest_digits(d: Column) -> Column:
    """The fewest digits that name a double, from the first to the last that is not 0; none for 0. Spark's own text may have
    one or two to spare where it has an exponent."""

    def fewer(size: Column, shown: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(shown, r"E.*$|\.", ""), "^0+|0+$", "")
        power = F.regexp_extract(shown, "E(-?[0-9]+)$", 1)

        def without(all_: Column, n: int) -> Column:
            held = F.round(all_.cast("decimal(20,0)"), -n).cast("string")
            same = lambda x: F.concat(x, F.lit("E"), power.cast("int") - F.length(all_) + 1).try_cast("double") == size
            return F.when(F.length(all_) > n, bound(held, lambda x: F.when(same(x), F.regexp_replace(x, "0+$", ""))))

        return bound(digits, lambda g: F.when(power == "", g).otherwise(F.coalesce(without(g, 2), without(g, 1), g)))

    return bound(F.abs(d), lambda size: bound(size.cast("string"), lambda shown: fewer(size, shown)))


def json_number_text(c: Column) -> Column:
    """A double as JSON shows it: the shortest digits that name it, ``.0`` behind whole numbers, an exponent from 1e16 on and
    below 1e-5; null for what is not finite."""
    d = c.cast("double")
    shown = F.abs(d).cast("string")
    power = F.regexp_extract(shown, "E(-?[0-9]+)$", 1).try_cast("int")
    point = lambda g: F.when(F.length(g) > 1, F.concat(F.substring(g, 1, 1), F.lit("."), F.substring(g, F.lit(2), F.length(g)))).otherwise(g)
    rounded_up = lambda g: F.when((g == "1") & shown.startswith("9"), 1).otherwise(0)
    exponent = F.concat(F.when(d < 0, "-").otherwise(""), bound(shortest_digits(d), lambda g: F.concat(point(g), F.lit("e"), power + rounded_up(g))))
    plain, size = number_text(d), F.abs(d)
    plain = F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))
    return F.when(F.isnan(d) | (size == float("inf")), F.lit(None).cast("string")).when((size == 0) | ((size >= 1e-5) & (size < 1e16)), plain).otherwise(exponent)


def grounded(quotes: Column, content: Column) -> Column:
    """Whether every quote is there: not blank, and part of the content once white space is collapsed in both."""
    held = collapse(content)
    return F.forall(quotes, lambda q: (collapse(q) != "") & F.contains(held, collapse(q)))


def bounded(c: Column, n: int | None) -> Column:
    """The first n characters; all, if n is 0 or None."""
    return F.substring(c, 1, n) if n else c


def labels(text: str) -> list[str]:
    """2 to 64 distinct labels between commas or line breaks."""
    out = [x.strip() for x in re.split(r"[,\n]", text) if x.strip()]
    if not 2 <= len(out) <= 64 or len(set(out)) < len(out):
        raise Refused("INVALID_INPUT", "2 to 64 distinct labels", "labels")
    return out


def scale(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(-?[0-9]+)\s*\.\.\s*(-?[0-9]+)\s*", text)
    if not m or int(m[1]) >= int(m[2]):
        raise Refused("INVALID_INPUT", "a scale is min..max, whole numbers, min below max", "scale")
    return int(m[1]), int(m[2])


def targets(text: str) -> dict[str, str]:
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if not isinstance(found, dict) or not 2 <= len(found) <= 64 or not all(isinstance(v, str) and v.strip() and k.strip() for k, v in found.items()):
        raise Refused("INVALID_INPUT", "a JSON object of 2 to 64 names with descriptions", "targets")
    return dict(sorted(found.items()))


def schema_size(schema) -> tuple[int, int]:
    """(depth, fields) of a JSON schema."""
    kids = list((schema.get("properties") or {}).values()) if isinstance(schema, dict) else []
    inner = kids + [schema["items"]] if isinstance(schema, dict) and isinstance(schema.get("items"), dict) else kids
    sizes = [schema_size(x) for x in inner]
    return 1 + max((d for d, _ in sizes), default=0), len(kids) + sum(n for _, n in sizes)


def guard_schema(schema, depth: int = 10, fields: int = 50) -> None:
    d, n = schema_size(schema)
    if d > depth or n > fields:
        raise Refused("INVALID_INPUT", f"the schema has depth {d} and {n} fields; {depth} and {fields} at most", "schema")


def outline(schema: dict, indent: int = 0) -> str:
    """A JSON schema as indented lines: name: type, with ? for what may be left out."""
    lines, must = [], set(schema.get("required", ()))
    for name, s in sorted((schema.get("properties") or {}).items()):
        kind = s.get("type", "enum" if "enum" in s else "any")
        kind = "/".join(kind) if isinstance(kind, list) else kind
        if "enum" in s:
            kind += " of " + ", ".join(map(str, s["enum"]))
        note = f" - {s['description']}" if s.get("description") else ""
        lines.append(f"{'  ' * indent}{name}{'' if name in must else '?'}: {kind}{note}")
        inner = s["items"] if isinstance(s.get("items"), dict) else s
        if inner.get("properties"):
            lines.append(outline(inner, indent + 1))
    return "\n".join(lines)
