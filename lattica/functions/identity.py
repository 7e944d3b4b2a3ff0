"""References, edge ids, cache keys and stable hashes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import vocab

#: White space that trimming removes: ASCII's and Unicode's.
_EDGE = r"[\s   -     　﻿]"
_POSITIONAL = r"(?i)^member-[a-z0-9]+-\d+$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(x), f"^{_EDGE}+|{_EDGE}+$", "")


def ref_error(kind: Column | str, key: Column | str) -> Column:
    """Why kind and key make no reference: unknown-kind, empty-key, positional-member or colon-in-key; else null."""
    kind, key = _col(kind), trimmed(F.coalesce(_col(key), F.lit("")))
    return (
        F.when(~F.coalesce(kind.isin(vocab.NODE_KINDS), F.lit(False)), "unknown-kind")
        .when(key == "", "empty-key")
        .when(F.regexp_like(key, F.lit(_POSITIONAL)), "positional-member")
        .when(F.contains(key, F.lit(":")) & (kind != "code"), "colon-in-key")
    )


def make_ref(kind: Column | str, key: Column | str, strict: bool = False) -> Column:
    """"kind:key", or null where ref_error has a reason; strict raises it instead."""
    kind, key = _col(kind), _col(key)
    why = ref_error(kind, key)
    bad = F.raise_error(F.concat(F.lit("reference: "), why)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(why.isNull(), F.concat(kind, F.lit(":"), trimmed(key))).otherwise(bad)


def ref_kind(ref: Column | str) -> Column:
    """What stands before a reference's first colon, null if the reference isn't well formed."""
    ref = _col(ref)
    at = F.instr(ref, ":")
    kind = F.substring(ref, F.lit(1), at - 1)
    return F.when((at > 1) & (at < F.length(ref)) & kind.isin(vocab.NODE_KINDS), kind)


def ref_key(ref: Column | str) -> Column:
    """What follows a reference's first colon, further colons included, null if it isn't well formed."""
    ref = _col(ref)
    return F.when(ref_kind(ref).isNotNull(), F.substring(ref, F.instr(ref, ":") + 1, F.length(ref)))


def is_ref(ref: Column | str) -> Column:
    return F.coalesce(ref_kind(ref).isNotNull(), F.lit(False))


def community_ref(version: Column | str, community: Column | str) -> Column:
    version, community = _col(version).cast("string"), _col(community).cast("string")
    blank = (trimmed(version) == "") | (trimmed(community) == "")
    return F.when(~blank, make_ref(F.lit("community"), F.concat(F.lit("v"), trimmed(version), F.lit("-"), trimmed(community))))


def corridor_ref(send: Column | str, receive: Column | str, rail: Column | None = None, family: Column | None = None) -> Column:
    """corridor:SEND→RECEIVE, then ·family and ·rail in lower case where given; direction matters."""
    way = F.concat(F.upper(trimmed(_col(send))), F.lit("→"), F.upper(trimmed(_col(receive))))
    none = F.lit(None).cast("string")
    some = [F.when(trimmed(x) != "", F.lower(trimmed(x))) if x is not None else none for x in (family, rail)]
    return make_ref(F.lit("corridor"), F.concat_ws("·", way, *some))


def code_ref(path: Column | str) -> Column:
    return make_ref(F.lit("code"), F.replace(trimmed(_col(path)), F.lit(":"), F.lit("/")))


def edge_id(kind: Column | str, source: Column | str, target: Column | str, disc: Column | None = None, blank_kind: bool = False) -> Column:
    """edge:{kind}:{source}→{target}[:{disc}]; null for a blank kind, unless blank_kind allows it (bare slice ids)."""
    kind = trimmed(_col(kind))
    tail = F.when(trimmed(disc) != "", F.concat(F.lit(":"), trimmed(disc))).otherwise("") if disc is not None else F.lit("")
    out = F.concat(F.lit("edge:"), kind, F.lit(":"), _col(source), F.lit("→"), _col(target), F.coalesce(tail, F.lit("")))
    return out if blank_kind else F.when(kind != "", out)


def cache_key(audience, lens, scope, tier, data_version, acl_version) -> Column:
    return F.concat_ws("|", F.lit("v1"), *map(_col, (audience, lens, scope, tier, data_version, acl_version)))


def is_shared_cacheable(audience: Column | str) -> Column:
    return _col(audience) == "public"


def match_key(x: Column | str) -> Column:
    """Trimmed and lower-cased, null as empty: the key that names are matched by."""
    return F.lower(trimmed(F.coalesce(_col(x), F.lit(""))))


def fnv1a(x: Column | str, start: int | Column = 2166136261) -> Column:
    """32-bit FNV-1a over a string's code units, as a long. Exact for characters of the basic plane."""
    begin = F.lit(start).cast("long") if isinstance(start, int) else start
    units = F.filter(F.split(_col(x), ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(units, begin, step)


def community_color(ref: Column | str) -> Column:
    """The palette colour of a community's reference."""
    palette = F.array(*map(F.lit, vocab.REF_PALETTE))
    return F.element_at(palette, (fnv1a(ref) % len(vocab.REF_PALETTE)).cast("int") + 1)


def seed_scalar(node: Column | str, salt: int) -> Column:
    """A stable number in [-1, 1) for a node and a salt."""
    return fnv1a(node, 2166136261 ^ salt) / F.lit(4294967296.0) * 2 - 1


def aliased(ref: Column | str, new_ref: Column | str) -> Column:
    """A reference after a left join with a table of renames."""
    return F.coalesce(_col(new_ref), _col(ref))
