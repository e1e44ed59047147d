"""Owner keys, script shapes and names, as native expressions. An owner key is the hex of a type byte and 32 bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words of the friendly names, in their order.
ADJECTIVES = """brave quick silent gentle bold clever curious dizzy eager fierce glad happy humble jolly keen lively lucky mellow nimble noble patient
playful proud quiet rapid restless shy sleepy sly snappy steady stubborn sunny swift tidy tiny vivid wandering wise zesty""".split()
COLORS = "teal amber coral indigo jade crimson cobalt olive violet copper pearl slate".split()
ANIMALS = """otter lynx crane fox owl badger heron marmot falcon tortoise hare raven seal ibis moth newt panda quail robin stoat tapir
urchin vole wren yak zebra gecko dolphin ferret magpie hedgehog jackal kiwi lemur mole narwhal osprey puffin squid toad""".split()


def owner_display(owner: Column) -> Column:
    """A bare key for type 00, a prefix that tells the type for the others; what isn't an owner key stays as it is."""
    rest, kind = F.substring(owner, 3, 64), F.substring(owner, 1, 2)
    name = {"01": "script:", "02": "covenant:", "03": "presence:"}
    out = F.when(kind == "00", rest)
    for k, p in name.items():
        out = out.when(kind == k, F.concat(F.lit(p), rest))
    return F.when(F.length(owner) != 66, owner).otherwise(out.otherwise(owner))


def owner_kind(owner: Column) -> Column:
    kind = F.substring(owner, 1, 2)
    return F.when(kind.isin("00", "03"), "wallet").when(kind == "01", "script").when(kind == "02", "covenant").otherwise("unknown")


def owner_key(kind: Column, owner: Column) -> Column:
    """hex(type, owner) of a type byte and an owner's bytes."""
    return F.lower(F.concat(F.hex(kind), F.hex(owner)))


def x_only(key: Column) -> Column:
    """A public key without its parity byte."""
    return F.when(F.length(key) == 33, F.substring(key, 2, 32)).otherwise(key)


def pay_to_key(script: Column) -> Column:
    """The key (32 or 33 bytes) of a pay-to-key script; null for other scripts."""
    h, n = F.hex(script), F.length(script)
    shape = n.isin(34, 35) & (F.conv(F.substring(h, 1, 2), 16, 10).cast("int") == n - 2) & (F.substring(h, -2, 2) == "AC")
    return F.when(shape, F.unhex(F.substring(h, F.lit(3), 2 * n - 4)))


def script_hash(script: Column) -> Column:
    """The 32-byte hash of a pay-to-script-hash script; null for other scripts."""
    h = F.hex(script)
    return F.when((F.length(script) == 35) & h.startswith("AA20") & h.endswith("87"), F.substring(script, 3, 32))


def strict_id(text: Column) -> Column:
    """32 bytes from 64 hex digits; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def outpoint(txid: Column, index: Column) -> Column:
    return F.concat_ws(":", txid, index.cast("string"))


def friendly_name(ident: Column) -> Column:
    """Adjective, colour and animal of a hex id; digits that are missing or no hex count as 0."""

    def pick(i: int, words: list[str]) -> Column:
        byte = lambda k: F.coalesce(F.when(F.substring(ident, 2 * k + 1, 2).rlike("^[0-9a-fA-F]+$"), F.conv(F.substring(ident, 2 * k + 1, 2), 16, 10)).cast("int"), F.lit(0))
        return F.get(F.array(*map(F.lit, words)), (byte(i) * 256 + byte(i + 1)) % len(words))

    return F.concat_ws("-", pick(0, ADJECTIVES), pick(2, COLORS), pick(4, ANIMALS))
