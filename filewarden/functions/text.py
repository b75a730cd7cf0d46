"""Scalar text helpers: words, paths, lists, addresses and version order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD_FIRST = "(?<![A-Za-z'-])[A-Za-z'-]"


def word_count(byte_chars: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens.

    One leading apostrophe or hyphen and one trailing hyphen of the whole text
    are not part of any word. Words are counted by their first character, which
    needs no array of all words.
    """
    length = F.length(byte_chars)
    head = F.substring(byte_chars, 1, 1).isin("'", "-").cast("int")
    tail = byte_chars.endswith("-").cast("int")
    body = F.substring(byte_chars, head + 1, F.greatest(length - head - tail, F.lit(0)))
    return F.length(body) - F.length(F.regexp_replace(body, _WORD_FIRST, ""))


def regex_literal(text: str) -> str:
    """Escape `text` so that a regex matches it literally."""
    return re.escape(text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, as written; '' without a dot."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def uri_path(path: Column) -> Column:
    """Path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")


def split_list(text: Column, separator: str) -> Column:
    """Separated text to an array of trimmed, non-empty entries."""
    parts = F.transform(F.split(text, regex_literal(separator)), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def sanitize_text(text: Column) -> Column:
    """Single-line plain text: tags removed, white space collapsed and trimmed."""
    untagged = F.regexp_replace(text, "<[^>]*>", "")
    return F.trim(F.regexp_replace(untagged, r"[\r\n\t ]+", " "))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"({_OCTET}\.){{3}}{_OCTET}"


def _ipv6() -> str:
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"({group}:){{7}}{group}", f"({group}:){{6}}{IPV4}"]
    # `::` stands for at least one group; n groups before it leave at most 7 - n after it.
    for before in range(8):
        head = "" if before == 0 else f"{group}(:{group}){{{before - 1}}}"
        after = 7 - before
        forms.append(f"{head}::" if after == 0 else f"{head}::({group}(:{group}){{0,{after - 1}}})?")
        if after >= 2:
            forms.append(f"{head}::({group}:){{0,{after - 2}}}{IPV4}")
    return "|".join(forms)


IP_ADDRESS = rf"^({IPV4}|{_ipv6()})$"


def client_ip(client: Column, forwarded_for: Column, remote: Column) -> Column:
    """First present of client, first forwarded hop and remote address; `unknown` if invalid."""

    def present(value: Column) -> Column:
        return value.isNotNull() & ~value.isin("", "0")

    first_hop = F.trim(F.element_at(F.split(forwarded_for, ","), 1))
    chosen = F.when(present(client), client).when(present(forwarded_for), first_hop).when(present(remote), remote)
    return F.when(chosen.rlike(IP_ADDRESS), chosen).otherwise("unknown")


# Order of version parts; a number and the end of the version sit between rc and patch level.
_VERSION_PART_ORDER = {"dev": 1, "alpha": 2, "a": 2, "beta": 3, "b": 3, "RC": 4, "rc": 4, "pl": 6, "p": 6}
_VERSION_NUMBER = 5


def version_key(version: Column) -> Column:
    """A sortable array for a version text: ``version_key(a) < version_key(b)`` iff a is older.

    Numbers compare as numbers (6.10 > 6.9), a longer number is newer
    (6.4 < 6.4.0) and pre-release parts come before the release.
    """
    dotted = F.regexp_replace(version, r"[-_+]+", ".")
    dotted = F.regexp_replace(dotted, r"(?<=[0-9])(?=[^0-9.])|(?<=[^0-9.])(?=[0-9])", ".")
    parts = F.filter(F.split(dotted, r"\."), lambda part: part != "")

    def part_key(part: Column) -> Column:
        order = F.when(part.rlike("^[0-9]+$"), F.lit(_VERSION_NUMBER))
        for word, rank in _VERSION_PART_ORDER.items():
            order = order.when(part == word, F.lit(rank))
        number = F.when(part.rlike("^[0-9]+$"), part.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.struct(order.otherwise(F.lit(0)).alias("kind"), number.alias("number"))

    end = F.array(F.struct(F.lit(_VERSION_NUMBER).alias("kind"), F.lit(-1).cast("bigint").alias("number")))
    return F.concat(F.transform(parts, part_key), end)
