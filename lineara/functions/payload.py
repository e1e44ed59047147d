"""Labels of a transaction's payload bytes, as native expressions.

Null payload gives null; an empty one gives the empty label.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes that the inscription decoder looks at.
INSCRIPTION_WINDOW = 2048


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def lane_namespace(payload: Column) -> Column:
    """The four-byte tag in hex, if sixteen zero bytes follow it."""
    zeros = F.unhex(F.lit("00" * 16))
    return F.when((F.length(payload) >= 20) & (F.substring(payload, 5, 16) == zeros), _hex(F.substring(payload, 1, 4)))


def payload_tag(payload: Column) -> Column:
    """``json``, ``jsonhex``, ``tag:`` with four bytes in hex, or '' under four bytes."""
    head = _hex(F.substring(payload, 1, 4))
    tag = F.when(head.startswith("7b22"), "json").when(head == "37623232", "jsonhex").otherwise(F.concat(F.lit("tag:"), head))
    return F.when(payload.isNull(), F.lit(None)).when(F.length(payload) < 4, "").otherwise(tag)


def inscription_json(payload: Column) -> Column:
    """The JSON text at the start of a payload, raw or as hexadecimal digits; null if there is none."""
    head = F.substring(payload, 1, INSCRIPTION_WINDOW)
    text = F.try_validate_utf8(head.cast("string"))
    run = F.regexp_extract(F.decode(head, "ISO-8859-1"), "^[0-9a-fA-F]*", 0)
    even = F.substring(run, F.lit(1), F.length(run) - F.length(run) % 2)
    plain = F.try_validate_utf8(F.unhex(even).cast("string"))
    start = _hex(F.substring(payload, 1, 4))
    return F.when(start.startswith("7b22"), text).when(start == "37623232", plain)


def inscription_kind(payload: Column) -> Column:
    """Label of an inscription: protocol, op and tick; or its type, its tick, or its first key. '' if the payload holds none."""
    dot = " · "

    def label_of(doc: Column) -> Column:
        def get(k: str) -> Column:
            # Only text values count.
            return F.when(doc.rlike(f'"{k}"\\s*:\\s*"'), F.get_json_object(doc, f"$.{k}"))

        def clip(x: Column) -> Column:
            return F.substring(x, 1, 24)

        tail = lambda k: F.coalesce(F.concat(F.lit(dot), clip(get(k))), F.lit(""))
        keys = F.json_object_keys(doc)
        label = (
            F.when(get("p").isNotNull(), F.concat(clip(get("p")), tail("op"), tail("tick")))
            .when(get("t").isNotNull(), clip(get("t")))
            .when(get("tick").isNotNull(), F.concat(F.lit(f"token{dot}"), clip(get("tick"))))
            .when(F.size(keys) > 0, clip(F.array_min(keys)))
            .otherwise("JSON")
        )
        return F.when(keys.isNotNull(), F.regexp_replace(label, "\\p{Cntrl}", "")).otherwise("")

    # The document is computed once for the row, however often the label looks at it.
    return F.when(payload.isNull(), F.lit(None)).otherwise(F.coalesce(F.get(F.transform(F.array(inscription_json(payload)), label_of), F.lit(0)), F.lit("")))
