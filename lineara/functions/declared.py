"""What authors declare of themselves in payloads and lists, read with care: inscriptions, token facts, links and ids.

Everything here is a claim of whoever wrote it. Texts that break a rule are null, never cut to fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Bytes of a genesis payload that may hold token facts.
LARGEST_FACTS = 4096
#: Fields of an inscription beside its protocol and operation.
FIELDS = ("tick", "amt", "max", "lim", "dec", "to")
#: The key of the generator of test traffic, its label, and the network and shape that stand for it where keys aren't known (fixed values).
GENERATOR = "TN10 traffic generator"
GENERATOR_KEY = "a39404c7f7a004b5eb51966981abeab40df55abf6f631c48399a42066bf182fa"
GENERATOR_NETWORK, GENERATOR_TEMPLATE = "testnet-10", "p2pk state"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trim(x: Column) -> Column:
    """Without the white space of any kind around it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_text(x: Column, most: int) -> Column:
    """A text without the white space around it; null if nothing is left, it is longer than ``most`` characters or has control characters."""
    return let(_trim(x), lambda t: F.when((t != "") & (F.length(t) <= most) & ~t.rlike(r"[\x00-\x1F\x7F-\u009F]"), t))


def safe_link(x: Column, most: int = 256) -> Column:
    """A link to https or ipfs; any other scheme is null, so that none that could run something gets further."""
    return let(clean_text(x, most), lambda t: F.when(F.lower(t).rlike("^(https|ipfs)://"), t))


def clean_id(x: Column) -> Column:
    """64 hexadecimal digits in lower case, or null."""
    return let(F.lower(_trim(x)), lambda t: F.when(t.rlike("^[0-9a-f]{64}$"), t))


def _object(text: Column) -> Column:
    """JSON text as a variant if it is an object."""
    return let(F.try_parse_json(text), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def inscription(payload: Column) -> Column:
    """proto, op and the ``FIELDS`` of a payload text that is a JSON object or its hexadecimal digits; null without a protocol and an
    operation. Numbers are given as text; fields that aren't stated are ''."""

    def read(p: Column) -> Column:
        digits = p.rlike("^[0-9a-fA-F]+$") & (F.length(p) % 2 == 0)
        # The bytes of a hexadecimal payload are read as one character each.
        return F.when(digits, _trim(F.decode(F.unhex(p), "ISO-8859-1"))).otherwise(p)

    def fields(v: Column) -> Column:
        say = lambda k: F.coalesce(_get(v, k), F.lit(""))
        return F.when((say("p") != "") & (say("op") != ""), F.struct(say("p").alias("proto"), say("op").alias("op"), *[say(k).alias(k) for k in FIELDS]))

    return let(_object(let(_trim(payload), read)), fields)


def chip(found: Column) -> Column:
    """A short label of an inscription; '' for none."""
    tick = F.when(found["tick"] != "", F.upper(found["tick"]))
    return F.when(found.isNull(), "").otherwise(F.concat_ws(" · ", F.upper(found["proto"]), F.lower(found["op"]), tick))


def token_facts(payload: Column) -> Column:
    """name, ticker, image, image_hash and decimals that a genesis payload claims, as JSON or as its hexadecimal digits.

    Null without a name or ticker, or if the payload is empty or larger than ``LARGEST_FACTS``. The first of ``ticker`` and ``symbol``
    that is stated counts. Decimals are a whole number of 0 to 255, as a number or as digits; anything else is undeclared.
    """

    def text(v: Column, key: str, most: int) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING"
        return clean_text(F.when(is_text, _get(v, key)), most)

    def facts(v: Column) -> Column:
        has = F.try_variant_get(v, "$.ticker", "variant").isNotNull()
        ticker = F.when(has, text(v, "ticker", 12)).otherwise(text(v, "symbol", 12))
        whole = let(_trim(_get(v, "decimals")), lambda t: F.when(t.rlike("^[+]?0*[0-9]{1,3}$") & (t.cast("int") <= 255), t.cast("int")))
        rest = [safe_link(text(v, "image", 256)).alias("image"), clean_id(text(v, "image_hash", 64)).alias("image_hash"), whole.alias("decimals")]
        said = F.struct(text(v, "name", 48).alias("name"), ticker.alias("ticker"))
        return let(said, lambda n: F.when(n["name"].isNotNull() | n["ticker"].isNotNull(), F.struct(n["name"].alias("name"), n["ticker"].alias("ticker"), *rest)))

    size = F.length(payload)
    hexed = lambda plain: let(_trim(plain), lambda t: F.when(t.rlike("^([0-9a-fA-F]{2})+$"), F.try_validate_utf8(F.unhex(t).cast("string"))))
    doc = let(F.try_validate_utf8(payload.cast("string")), lambda plain: F.coalesce(_object(plain), _object(hexed(plain))))
    return F.when((size > 0) & (size <= LARGEST_FACTS), let(doc, facts))


def price(quote: Column, base: Column) -> Column:
    """The price of a whole token from the exact pair of amounts, with as many places as its size needs. For display only: it is rounded
    by the float's own value."""
    px = F.try_divide(F.try_divide(quote, base), F.lit(1e8))
    digits = lambda n: F.call_function("format_number", px, F.lit("0." + "0" * n))
    shown = F.when(px >= 1, digits(4)).when(px >= 0.0001, digits(6)).otherwise(digits(8))
    return F.when(px > 0, F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")).otherwise("—")


def unit_price(quote: Column, size: Column) -> Column:
    """Smallest units for a token, as a float: what a book sorts by when it shows levels; 0 without a size."""
    return F.when(size > 0, quote.cast("double") / size).otherwise(0.0)


def shown_bytes(n: Column) -> Column:
    """A number of bytes in the largest unit in which it is at least one, up to TiB."""
    v, out = n.cast("double"), None
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    for k, unit in enumerate(units):
        text = F.concat(F.format_string("%.1f", v / 1024**k), F.lit(f" {unit}"))
        here = v < 1024.0 ** (k + 1)
        out = F.when(here, text) if out is None else out.when(here, text) if k < len(units) - 1 else out.otherwise(text)
    return F.when(n.isNotNull(), out)


def shown_latency(bound: Column) -> Column:
    """The upper bound of a class of latencies in seconds; null, the open class, is ``>10s``."""
    return F.when(bound.isNull(), ">10s").when(bound < 1, F.concat(F.lit("≤"), F.format_string("%.0f", bound * 1000), F.lit("ms"))).otherwise(F.concat(F.lit("≤"), F.format_string("%.1f", bound), F.lit("s")))


def since(raw: Column, now: Column) -> Column:
    """Where a report begins: ``30m``, ``24h`` or ``7d`` before ``now``, or a stated time (UTC where it names no zone); null for ``all``
    and for anything else."""
    t = F.lower(_trim(raw))
    size, unit = F.regexp_extract(t, "^([0-9]{1,9})([mhdw])$", 1), F.regexp_extract(t, "^([0-9]{1,9})([mhdw])$", 2)
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).when(unit == "w", 604_800)
    back = F.timestamp_seconds(F.unix_micros(now) / F.lit(1_000_000) - size.try_cast("long") * seconds)
    return F.when(t == "all", F.lit(None)).when(unit != "", back).otherwise(raw.try_cast("timestamp"))


def generator_label(holders: Column, network: Column, template: Column) -> Column:
    """The generator's label where its key is among the known holders; where none are known, by the shape of its coins."""
    known = F.exists(holders, lambda h: F.coalesce(F.lower(h) == GENERATOR_KEY, F.lit(False)))
    proxy = (network == GENERATOR_NETWORK) & (template == GENERATOR_TEMPLATE)
    return F.when(F.size(holders) > 0, F.when(known, GENERATOR)).when(proxy, GENERATOR)


def phase_chip(phase: Column, progress_bps: Column) -> Column:
    """How a market's phase is shown, with the progress of one that still sells from its curve; '' where the phase isn't known."""
    percent = F.when(progress_bps.isNotNull(), F.concat(F.lit(" · "), F.round(progress_bps / 100).cast("long").cast("string"), F.lit("%"))).otherwise("")
    known = phase.isNotNull() & ~phase.isin("", "unknown")
    return F.when(known, F.when(phase == "bonding", F.concat(F.lit("bonding"), percent)).when(phase == "graduated", "bonding complete").otherwise("pool shares")).otherwise("")


def batch_family(templates: Column) -> Column:
    """Whether all members of a family that have a meaningful template are of a marketplace's batches, and at least one is."""
    named = F.filter(templates, lambda t: (t != "") & ~t.rlike("^p2(pk|sh)"))
    return F.coalesce((F.size(named) > 0) & F.forall(named, lambda t: t.rlike("^genesis0")), F.lit(False))
