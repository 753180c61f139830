"""XML bodies as structure: parsed by explicit schemas, so that entities, quotes, CDATA and nesting are the parser's business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The element that a body is put into, so that what stands beside its root is seen.
_AROUND = "tidemark"
_PLACE = "array<struct<_poiname:string,_label:string,_x:string,_y:string>>"
_LINK = "array<struct<_name:string,plain:array<string>,title:array<string>,memberlist:array<struct<member:array<struct<nickname:array<string>>>>>>>"
_TEMPLATE = f"array<struct<content_template:array<struct<plain:array<string>,template:array<string>,link_list:array<struct<link:{_LINK}>>>>>>"

#: The roots that bodies have, with what is read of each.
ROOTS = {
    "location": _PLACE,
    "msg": f"array<struct<location:{_PLACE}>>",
    "sysmsg": f"array<struct<_type:string,revokemsg:array<string>,sysmsgtemplate:{_TEMPLATE}>>",
}


def wrapped(xml: Column) -> Column:
    """The body without its declaration, inside one element."""
    return F.concat(F.lit(f"<{_AROUND}>"), F.regexp_replace(xml, r"^\s*<\?xml\s[^>]*\?>", ""), F.lit(f"</{_AROUND}>"))


def document(xml: Column) -> Column:
    """A struct with an array for each known root, or null where the body isn't one well-formed element.

    Text or a second element beside the root makes it no document, as in any parser; unknown roots leave all arrays null.
    """
    fields = ", ".join(f"{name} {kind}" for name, kind in ROOTS.items())
    found = F.from_xml(wrapped(xml), f"{fields}, _VALUE string, xs_any array<string>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})

    def counted(name: str) -> Column:
        return F.coalesce(F.size(found[name]), F.lit(0))

    elements = sum((counted(name) for name in (*ROOTS, "xs_any")), F.lit(0))
    beside = F.coalesce(F.trim(found["_VALUE"]) != "", F.lit(False))
    return F.when(found["_corrupt"].isNull() & (elements == 1) & ~beside, found)


def one_element(xml: Column) -> Column:
    """The text itself if it is one well-formed element of any name, else null."""
    found = F.from_xml(wrapped(xml), "_VALUE string, xs_any array<string>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    whole = found["_corrupt"].isNull() & (F.size(found["xs_any"]) == 1) & F.coalesce(F.trim(found["_VALUE"]) == "", F.lit(True))
    return F.when(whole, xml)


def leading_text(xml: Column, parsed: Column, value: Column, path: str) -> Column:
    """The text of an element before its first child: ``value``, unless that holds a sign of markup; then what is at ``path``."""
    inside = F.xpath_string(F.when(parsed.isNotNull() & F.contains(value, F.lit("<")), wrapped(xml)).otherwise(F.lit(f"<{_AROUND}/>")), F.lit(f"/{_AROUND}/{path}/node()[1][self::text()]"))
    return F.when(F.contains(value, F.lit("<")), F.nullif(inside, F.lit(""))).otherwise(value)


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def flat(values: Column, name: str) -> Column:
    """The field's values of all structs, one after another; null fields give none."""
    return F.flatten(F.filter(F.transform(values, lambda x: x[name]), lambda x: x.isNotNull()))
