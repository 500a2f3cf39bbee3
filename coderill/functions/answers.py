"""JSON answers of the serving views, parsed to typed columns, with the path of the first fault where one has another shape.

A shape is a name of a kind, with ``?`` where null may stand for it, a tuple of allowed texts, a list of one
shape for arrays, or a dict of members, all of which must be there; other members are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = str | tuple | list | dict

#: Fixed names: members of the serving views' answers, in the order in which they are looked at.
_ORIGINS = {name: "number" for name in ("created", "seen", "impl", "fetched", "unknown")}
_EVENT = {
    "id": "number", "kind": ("ALERT", "UPGRADE"), "block": "number", "at": "text", "address": "text", "seed_address": "text?", "label": "text?",
    "origin": "text?", "old_impl": "text?", "new_impl": "text?", "score": "number?",
}
SHAPES: dict[str, Shape] = {
    "health": {"progress": "number?", "progress_at": "text?", "seconds_since_progress": "number?", "now": "text"},
    "events": {"last_id": "number", "events": [_EVENT]},
    "summary": {
        "addresses": "number", "codes": "number", "seeds": "number", "implementations_resolved": "number", "origins": _ORIGINS,
        "alerts_by_seed": [{"label": "text", "seed_address": "text", "count": "number"}], "recent": {"blocks": "number", "by_origin": _ORIGINS},
    },
    "clusters": {"level": "text", "n": "number", "clusters": [{"level": "text", "key": "text", "members": ["text"]}]},
}
_KINDS = {"number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "text": "^STRING$"}


def _is(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def fault(value: Column, shape: Shape, path: Column | None = None) -> Column:
    """The path, as in ``$.events[3].score``, at which a variant first departs from a shape; null where it has the shape."""
    path = F.lit("$") if path is None else path
    if isinstance(shape, str):
        kind = _KINDS[shape.rstrip("?")]
        return F.when(~_is(value, f"{kind}|^VOID$" if shape.endswith("?") else kind), path)
    if isinstance(shape, tuple):
        return F.when(~(_is(value, _KINDS["text"]) & F.coalesce(F.try_variant_get(value, "$", "string").isin(*shape), F.lit(False))), path)
    if isinstance(shape, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        found = F.transform(items, lambda item, i: fault(item, shape[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(~_is(value, "^ARRAY<"), path).otherwise(F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0)))
    members = [fault(F.try_variant_get(value, f"$.{name}", "variant"), inner, F.concat(path, F.lit(f".{name}"))) for name, inner in shape.items()]
    return F.when(~_is(value, "^OBJECT<"), path).otherwise(F.coalesce(*members))


def type_of(shape: Shape) -> str:
    """The Spark type of what has a shape; numbers are doubles, as readers of these answers have no others."""
    if isinstance(shape, str):
        return "double" if shape.startswith("number") else "string"
    if isinstance(shape, tuple):
        return "string"
    if isinstance(shape, list):
        return f"array<{type_of(shape[0])}>"
    return "struct<" + ",".join(f"{name}:{type_of(inner)}" for name, inner in shape.items()) + ">"


def checked(text: Column, shape: Shape) -> Column:
    """Struct (fault, value): the typed answer, or null and the path of its first fault; ``$`` for what is null or no JSON.

    A text with a member's name twice in one object is taken for no JSON.
    """
    parsed = F.try_parse_json(text)
    wrong = fault(parsed, shape)
    return F.struct(wrong.alias("fault"), F.when(wrong.isNull(), F.try_variant_get(parsed, "$", type_of(shape))).alias("value"))
