"""Addresses of both versions, networks and prefix lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def ip_number(text: Column) -> Column:
    """A dotted address as a number, null if it isn't one."""
    octets = F.split(text, r"\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.get(octets, F.lit(k)).try_cast("long")
    return F.when(text.rlike(_V4), number)


def ip_text(number: Column) -> Column:
    """The dotted form of a number."""
    return F.concat_ws(".", *[(F.shiftright(number, 8 * k).bitwiseAND(F.lit(255))).cast("string") for k in (3, 2, 1, 0)])


def network_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last number of a network in prefix notation."""
    bits = F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    low = ip_number(F.get(F.split(cidr, "/"), F.lit(0)))
    low = low - F.pmod(low, size)
    return low, low + size - 1


_GROUP = "^[0-9a-f]{1,4}$"


def address_hex(text: Column) -> Column:
    """The 128 bits of an address of either version as 32 hexadecimal digits, null for other text.

    An IPv4 address is the IPv6 one that stands for it, ::ffff:a.b.c.d; a zone at the end doesn't count.
    """

    def groups(halves: Column, k: int) -> Column:
        part = F.coalesce(F.get(halves, F.lit(k)), F.lit(""))
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def joined(halves: Column) -> Column:
        def padded(x: Column) -> Column:
            used = F.size(x["left"]) + F.size(x["right"])
            fits = F.when(F.size(halves) == 2, used <= 7).otherwise((F.size(halves) == 1) & (used == 8))
            right = F.forall(F.concat(x["left"], x["right"]), lambda g: g.rlike(_GROUP))
            return F.when(fits & right, F.array_join(F.transform(F.concat(x["left"], F.array_repeat(F.lit("0"), 8 - used), x["right"]), lambda g: F.lpad(g, 4, "0")), ""))

        return F.transform(F.array(F.struct(groups(halves, 0).alias("left"), groups(halves, 1).alias("right"))), padded)[0]

    def six(plain: Column) -> Column:
        tail = F.regexp_extract(plain, r"([0-9.]+)$", 1)
        quad = F.lower(F.lpad(F.hex(ip_number(tail)), 8, "0"))
        both = F.when(plain.contains("."), F.concat(F.substring(plain, F.lit(1), F.char_length(plain) - F.char_length(tail)), F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4))).otherwise(plain)
        return F.transform(F.array(F.split(both, "::")), joined)[0]

    # Most addresses are of four numbers: the others' own expression is looked at for those with a colon only.
    four = F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(ip_number(text)), 8, "0")))
    return F.when(text.contains(":"), F.transform(F.array(F.regexp_replace(F.lower(text), r"%\w+$", "")), six)[0]).otherwise(four)


def prefix(digits: Column, bits: Column) -> Column:
    """The first bits of an address's digits, as whole digits and one that is cleared below the last bit."""
    whole = F.floor(bits / 4).cast("int")
    keep = F.element_at(F.array(F.lit(0), F.lit(8), F.lit(12), F.lit(14)), F.pmod(bits, F.lit(4)).cast("int") + 1)
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int").bitwiseAND(keep)
    return F.when(F.pmod(bits, F.lit(4)) == 0, F.substring(digits, F.lit(1), whole)).otherwise(F.concat(F.substring(digits, F.lit(1), whole), F.lower(F.hex(digit))))


def network_bits(cidr: Column) -> Column:
    """How many of the 128 bits a network in prefix notation fixes; an address alone fixes all. Null for what is no network."""
    four = F.get(F.split(cidr, "/"), F.lit(0)).rlike(_V4)
    given = F.get(F.split(cidr, "/"), F.lit(1))
    own = F.when(~cidr.contains("/"), F.when(four, 32).otherwise(128)).otherwise(given.try_cast("int"))
    return F.when(own.between(0, F.when(four, 32).otherwise(128)), F.when(four, own + 96).otherwise(own))


def in_networks(df: DataFrame, ip: str, networks: DataFrame, cidr: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns of the longest network that holds their address, null without one. Both versions of addresses may be mixed.

    With keys, which both tables have, networks are those of the row's own keys. The prefix lengths in use (129 at most) are collected; each
    distinct address is joined by equality once for each of them, so no range join or cross product is made.
    """
    others = [c for c in networks.columns if c not in keys]
    nets = networks.withColumn("__bits", network_bits(F.col(cidr))).withColumn("__net", prefix(address_hex(F.get(F.split(F.col(cidr), "/"), F.lit(0))), F.col("__bits"))).filter("__net is not null")
    lengths = sorted(r[0] for r in nets.select("__bits").distinct().collect())
    digits = F.col("__digits")
    made = F.array(*[F.struct(F.lit(b).alias("bits"), prefix(digits, F.lit(b)).alias("net")) for b in lengths]) if lengths else F.array().cast("array<struct<bits:int,net:string>>")
    asked = df.select(*keys, ip).distinct().withColumn("__digits", address_hex(F.col(ip))).filter("__digits is not null")
    spread = asked.select(*keys, ip, F.explode(made).alias("__k")).select(*keys, ip, F.col("__k.bits").alias("__bits"), F.col("__k.net").alias("__net"))
    found = spread.join(nets, [*keys, "__bits", "__net"]).groupBy(*keys, ip).agg(F.max(F.struct("__bits", *others)).alias("__m"))
    return df.join(found.select(*keys, ip, *[F.col(f"__m.{c}").alias(c) for c in others]), [*keys, ip], "left")


def source_verdicts(logins: DataFrame, user: str, ip: str, place: str, specs: DataFrame, anyone: str = "*") -> DataFrame:
    """logins with `basis` and `verdict`: whether a login's source is one that its user may have.

    specs (user, cidr, place) has for each user networks and places, the other one null; rows of the user `anyone` hold for all. basis says what fits:
    `network`, `place`, `any network`, `any place`, or null. The verdict is `expected` where something fits, `anomaly` where
    the user has specs of their own and nothing fits, else `no spec`. Rows without user or address have none. An address meets its longest network.
    """
    spec = specs.select(F.col("user").alias(user), "cidr", F.col("place").alias("__place"))
    own_nets, all_nets = spec.filter(F.col("cidr").isNotNull() & (F.col(user) != anyone)), spec.filter(F.col("cidr").isNotNull() & (F.col(user) == anyone))
    rows = in_networks(logins, ip, own_nets.select(user, F.col("cidr").alias("__cidr")), "__cidr", (user,))
    rows = in_networks(rows, ip, all_nets.select(F.col("cidr").alias("__any")), "__any")
    places = spec.filter(F.col("__place").isNotNull()).distinct()
    mine = places.filter(F.col(user) != anyone).select(user, F.col("__place").alias(place), F.lit(True).alias("__at"))
    everyone = places.filter(F.col(user) == anyone).select(F.col("__place").alias(place), F.lit(True).alias("__any_at"))
    known = spec.filter(F.col(user) != anyone).select(user).distinct().withColumn("__known", F.lit(True))
    met = rows.join(mine, [user, place], "left").join(everyone, [place], "left").join(known, [user], "left")
    basis = F.when(F.col("__cidr").isNotNull(), "network").when(F.col("__at"), "place").when(F.col("__any").isNotNull(), "any network").when(F.col("__any_at"), "any place")
    whole = F.col(user).isNotNull() & F.col(ip).isNotNull()
    verdict = F.when(whole, F.when(F.col("basis").isNotNull(), "expected").when(F.col("__known"), "anomaly").otherwise("no spec"))
    return met.withColumn("basis", F.when(whole, basis)).withColumn("verdict", verdict).select(*logins.columns, "basis", "verdict")


def drifted(sent: Column, received: Column, most: int = 600) -> Column:
    """Whether a message's own time, in seconds, is further than so many seconds from the time at which it was received, on either side."""
    return F.abs(received - sent) > most
