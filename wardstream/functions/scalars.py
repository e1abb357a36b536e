"""Scalar functions as Column expressions. Only JSON of unknown shape needs Arrow UDFs.

Two families share names in the source semantics: records (``record_*``, strict or repairing) and events
(``event_*``, lenient: an odd value is kept for validation to report).
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it: keeps nested expressions from growing by copies."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A literal map lookup; null for unknown keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def strip(c: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; empty text becomes null."""
    return F.nullif(F.regexp_replace(strip(c), r"(?U)\s+", " "), F.lit(""))


def rounded(c: Column, digits: int = 4) -> Column:
    """Half-up by floor, the same arithmetic in every engine."""
    return F.floor(c * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


_GROUP = "[0-9a-fA-F]{1,4}"
_IPV6 = f"^(?:{_GROUP}(?::{_GROUP})*)?(?:::(?:{_GROUP}(?::{_GROUP})*)?)?$"


def _hex_tail(body: Column) -> Column:
    """An IPv4 address at the end of IPv6 text as two groups; null if it is none."""
    number = F.transform(F.split(F.regexp_extract(body, r"([\d.]+)$", 1), "[.]"), lambda x: x.try_cast("int"))
    pair = let(number, lambda n: F.concat_ws(":", *[F.hex(F.get(n, F.lit(i)) * 256 + F.get(n, F.lit(i + 1))) for i in (0, 2)]))
    good = _ipv4(F.regexp_extract(body, r":([\d.]+)$", 1), False).isNotNull()
    return F.when(body.contains("."), F.when(good, F.concat(F.regexp_extract(body, r"^(.*:)[\d.]+$", 1), pair))).otherwise(body)


def _packed(text: Column) -> Column:
    """The longest run of zero groups (two at least, the first of equals) as ::."""
    runs = [f"^(.*?)(?:^|:)0(?::0){{{k}}}(?::|$)(.*)$" for k in range(7, 0, -1)]
    return F.coalesce(*[F.when(text.rlike(r), F.regexp_replace(text, r, "$1::$2")) for r in runs], text)


def _groups(body: Column) -> Column:
    """Text of all eight groups without leading zeros, or null."""
    parts = lambda side: F.filter(F.split(F.split_part(body, F.lit("::"), F.lit(side)), ":"), lambda x: x != "")
    whole = lambda p: let(F.size(p["l"]) + F.size(p["r"]), lambda n: F.when(F.when(body.contains("::"), n <= 7).otherwise(n == 8), F.concat(p["l"], F.array_repeat(F.lit("0"), 8 - n), p["r"])))
    full = let(F.struct(parts(1).alias("l"), parts(2).alias("r")), whole)
    return F.when(body.rlike(_IPV6), F.array_join(F.transform(full, lambda x: F.lower(F.regexp_replace(x, "^0+(?=.)", ""))), ":"))


def _ipv6_text(c: Column) -> Column:
    """Canonical IPv6 text, a scope (%name) kept; else null."""
    body = _hex_tail(F.regexp_replace(c, "%[^%]+$", ""))
    return F.concat(let(let(body, _groups), _packed), F.regexp_extract(c, "(%[^%]+)$", 1))


def _ipv4(c: Column, repair: bool) -> Column:
    part = r"\d{1,3}" if repair else r"(?:0|[1-9]\d{0,2})"
    number = F.transform(F.split(c, "[.]"), lambda x: x.try_cast("int"))
    good = c.rlike(rf"^{part}(?:\.{part}){{3}}$") & F.forall(number, lambda x: x <= 255)
    return F.when(good, F.array_join(F.transform(number, lambda x: x.cast("string")), "."))


def _either(s: Column, repair: bool, ipv6: bool) -> Column:
    return F.when(s.contains(":"), _ipv6_text(s)).otherwise(_ipv4(s, repair)) if ipv6 else _ipv4(s, repair)


def record_ip(c: Column, ipv6: bool = True) -> Column:
    """IPv4 with leading zeros repaired, canonical IPv6, else null. ``ipv6=False`` makes a smaller plan for IPv4 data."""
    return let(strip(c), lambda s: F.when(~s.isin(vocab.MISSING_WORDS), _either(s, True, ipv6)))


def event_ip(c: Column, ipv6: bool = True) -> Column:
    """Strict IPv4 or IPv6 in canonical text, else null."""
    return let(strip(c), lambda s: _either(s, False, ipv6))


def record_port(c: Column) -> Column:
    number = c.cast("string").try_cast("double").try_cast("bigint")
    return F.when(number.between(0, 65535), number.cast("int"))


def safe_long(c: Column) -> Column:
    """Whole number by way of a float, null if there is none."""
    return strip(c.cast("string")).try_cast("double").try_cast("bigint")


def safe_double(c: Column) -> Column:
    d = strip(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def record_protocol(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.nullif(F.coalesce(lookup(s, vocab.PROTOCOL_NUMBERS), s), F.lit(""))


def record_severity(c: Column) -> Column:
    return lookup(F.lower(strip(c)), vocab.RECORD_SEVERITY)


def record_hash(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.when(s.rlike("^[0-9a-f]+$") & F.length(s).isin(32, 40, 64), s)


def _iso_micros(t: Column) -> Column:
    """isoformat() of a UTC time: microseconds only if there are some."""
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.date_format(t, ISO), fraction, F.lit("+00:00"))


#: Pattern and shape of the record timestamps, day before month, in search order.
RECORD_FORMATS = [
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy/M/d H:m:s", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("M/d/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$"),
    ("d/M/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
]


def _parsed(s: Column, formats: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f))) for f, shape in formats])


def record_timestamp(c: Column) -> Column:
    """ISO text as it is; listed formats (UTC) and epochs as ISO text with +00:00; else null."""

    def epoch(number: Column) -> Column:
        return let(F.when(number > 1e12, number / 1000).otherwise(number), lambda e: F.when((e > 0) & (e < 2e10), F.timestamp_micros(F.floor(e * 1e6 + 0.5).cast("bigint"))))

    def read(s: Column) -> Column:
        iso = s.contains("T") & (s.endswith("Z") | F.substring(s, 11, 1000).contains("+"))
        at = F.coalesce(_parsed(s, RECORD_FORMATS), let(s.try_cast("double"), epoch))
        return F.when(~s.isin("", *vocab.MISSING_WORDS), F.when(iso, s).otherwise(let(at, _iso_micros)))

    return let(strip(c), read)


#: The same for events.
EVENT_FORMATS = [
    ("yyyy/M/d H:m:s", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/MMM/yyyy:H:m:s", r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("M/d/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d-MMM-yyyy H:m:s", r"^\d{1,2}-[A-Za-z]{3}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
]
_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def event_timestamp(c: Column) -> Column:
    """Epochs (digits alone always), ISO with offsets, listed formats; text ...SSZ in UTC, fractions dropped."""

    def read(s: Column) -> Column:
        number = F.when(s.rlike(r"^-*\d*\.?\d+$|^-*\d+\.$"), s.try_cast("double"))
        at = let(number, lambda n: F.timestamp_seconds(F.floor(F.when(n >= 1e11, n / 1000).otherwise(n)).cast("bigint")))
        iso = F.when(s.rlike(_ISO_SHAPE), F.try_to_timestamp(s))
        year = F.when(s.rlike(r"^[A-Za-z]{3}\s+\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), F.regexp_replace(s, r"\s+", " "))
        syslog = F.try_to_timestamp(F.concat(F.lit("1900 "), year), F.lit("yyyy MMM d H:m:s"))
        return F.date_format(F.coalesce(at, iso, _parsed(s, EVENT_FORMATS), syslog), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    return let(strip(c), read)


def event_severity(c: Column) -> Column:
    return lookup(F.lower(strip(c)), vocab.EVENT_SEVERITY)


def event_lower(c: Column) -> Column:
    """Hostname, protocol and hash: collapsed, lower case."""
    return F.lower(collapse(c))


def event_domain(c: Column) -> Column:
    return F.nullif(F.lower(F.rtrim(collapse(c), F.lit("."))), F.lit(""))


def event_status(c: Column) -> Column:
    """Known words by their meaning, as text; others collapsed, lower case."""
    s = event_lower(c)
    return F.coalesce(lookup(s, vocab.EVENT_STATUS), s)


def hash_algorithm(c: Column) -> Column:
    known = F.when(F.length(c) == 32, "md5").when(F.length(c) == 40, "sha1").when(F.length(c) == 64, "sha256")
    return F.when(c.rlike("^[0-9a-fA-F]+$"), known)


def field_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def search_tokens(c: Column) -> Column:
    """Lower-case terms that keep addresses and ids whole, without stop words and single characters."""
    terms = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_.\-]+"), F.lit(0))
    return F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(vocab.STOP_WORDS))


def entropy_bits(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def flat_entries(text: str) -> dict[str, str | None] | None:
    """Dotted paths of a JSON object of any shape, down to five levels; deeper parts are dropped. None: no JSON."""
    import json

    def walk(v, prefix: str, depth: int) -> None:
        if depth > 4:
            return
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, (dict, list)):
                    walk(x, f"{prefix}{k}.", depth + 1)
                else:
                    out[f"{prefix}{k}"] = x if isinstance(x, str) or x is None else json.dumps(x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{prefix}{i}.", depth + 1)
        else:
            out[prefix.rstrip(".")] = v if isinstance(v, str) or v is None else json.dumps(v)

    try:
        doc = json.loads(text)
    except ValueError:
        return None
    out: dict = {}
    if doc is not None:
        walk(doc, "", 0)
    return out


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_json(a: pa.Array) -> pa.Array:
    """The entries of flat_entries() as a map."""
    # The maps of a batch are laid out as one list of keys and one of values: no map is made of Python objects.
    starts, keys, values = [], [], []
    for x in a:
        held = flat_entries(x.as_py()) if x.is_valid else None
        starts.append(None if held is None else len(keys))
        if held:
            keys.extend(held)
            values.extend(held.values())
    return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


ALIASES = {spelling: i for i, words in enumerate(vocab.FIELD_ALIASES.values()) for spelling in words}


@functools.lru_cache(1 << 16)
def field_place(key: str) -> int | None:
    """Which field of vocab.FIELD_ALIASES a key of any spelling stands for."""
    return ALIASES.get(re.sub("[^a-z0-9]", "", key.lower()))


@F.arrow_udf(T.StructType().add("known", T.ArrayType(T.StringType())).add("rest", T.MapType(T.StringType(), T.StringType())))
def event_entries(a: pa.Array) -> pa.Array:
    """Of the entries of flat_entries() that are not empty, the first of each field, in the order of vocab.FIELD_ALIASES,
    and those of no field. ``rest`` is null where the text is no JSON."""
    n = len(vocab.FIELD_ALIASES)
    known, starts, keys, values = [], [], [], []
    for x in a:
        held = flat_entries(x.as_py()) if x.is_valid else None
        starts.append(None if held is None else len(keys))
        first = [None] * n
        for k, v in (held or {}).items():
            if v:
                i = field_place(k)
                if i is None:
                    keys.append(k)
                    values.append(v)
                elif first[i] is None:
                    first[i] = v
        known.extend(first)
    cuts = pa.array(range(0, len(known) + 1, n), pa.int32())
    rest = pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(known, pa.string())), rest], ["known", "rest"])


@F.arrow_udf(T.StringType())
def sorted_json(a: pa.Array) -> pa.Array:
    """A JSON line with keys sorted at every level and no blanks; text that is no JSON stays as it is."""
    import json

    def one(x: str) -> str:
        try:
            return json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return x

    # A batch is gone through in slices: of Python's own texts a task holds those of one slice only.
    slices = [pa.array([one(x) if x is not None else None for x in a.slice(i, 256).to_pylist()], pa.string()) for i in range(0, len(a), 256)]
    return pa.concat_arrays(slices) if slices else pa.array([], pa.string())
