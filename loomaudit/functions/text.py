"""Text, hash, cache and header functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(t: Column) -> Column:
    """Words set apart by white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def reading_time(t: Column) -> Column:
    return F.ceil(word_count(t) / 200)


def byte_length(t: Column) -> Column:
    return F.octet_length(t)


def truncate_bytes(t: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that doesn't split a character."""
    cut = F.substring(F.encode(t, "UTF-8"), 1, limit)
    # drop a character that was cut: its bytes are replaced when read leniently
    read = F.try_validate_utf8(cut.cast("string"))
    out = read
    for k in (1, 2, 3):
        out = F.coalesce(out, F.try_validate_utf8(F.substring(F.encode(t, "UTF-8"), 1, limit - k).cast("string")))
    return F.when(F.octet_length(t) <= limit, t).otherwise(out)


def normalized_hash(t: Column) -> Column:
    """For grouping by trimmed lower-case text; null for null and empty text."""
    n = F.lower(F.trim(t))
    return F.when(n != "", F.sha2(n, 256))


def content_hash(t: Column) -> Column:
    return F.sha2(t, 256)


def markup_hash(t: Column) -> Column:
    """After white space is folded and that between tags is dropped."""
    return F.sha2(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r">\s+<", "><")), 256)


def clamp_id(t: Column, limit: int) -> Column:
    """Cut to ``limit`` characters with a hash as suffix, so that long ids stay distinct."""
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 17), F.lit("~"), F.substring(F.sha2(t, 256), 1, 16))).otherwise(t)


def fingerprint(*parts: Column) -> Column:
    """256 bits over a tuple in which null and text differ."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))), 256)


def tokens(t: Column) -> Column:
    """Distinct lower-case tokens of letters and digits longer than one."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(t: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def syllables(word: Column) -> Column:
    """Groups of vowels, at least one; a silent e at the end doesn't count."""
    groups = F.regexp_count(F.regexp_replace(F.lower(word), r"(?<=[a-z]{2})e$", ""), F.lit("[aeiouy]+"))
    return F.greatest(groups, F.lit(1))


def flesch(t: Column) -> Column:
    """Reading ease from sentences, words and syllables; null below five sentences or a hundred words."""
    w = F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))
    n = F.size(w)
    s = F.regexp_count(t, F.lit(r"[.!?]+"))
    syl = F.aggregate(w, F.lit(0), lambda acc, x: acc + syllables(x))
    return F.when((s >= 5) & (n >= 100), 206.835 - 1.015 * n / s - 84.6 * syl / n)


def mojibake_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit("Ã.|â€.|Â.|�"))


def cache_directives(header: Column) -> Column:
    """Cache-Control as a map from lower-case names to values."""
    return F.str_to_map(F.regexp_replace(F.lower(header), r"\s*,\s*", ","), F.lit(","), F.lit("="))


def cache_lifetime(header: Column) -> Column:
    """Seconds: immutable one year, else s-maxage, else max-age; null without any."""
    d = cache_directives(header)
    number = lambda k: F.expr("try_cast(null as bigint)") if k is None else F.try_to_number(F.regexp_replace(d[k], '"', ""), F.lit("9999999999")).cast("bigint")
    return F.when(F.map_contains_key(d, "immutable"), F.lit(31536000).cast("bigint")).otherwise(F.coalesce(number("s-maxage"), number("max-age")))


def change_status(prev_etag: Column, etag: Column, prev_modified: Column, modified: Column, prev_hash: Column, now_hash: Column) -> Column:
    """Etag first, then last-modified, then the content's hash; new if nothing was known, unknown if nothing can be compared."""
    known = F.coalesce(prev_etag, prev_modified, prev_hash)
    verdict = lambda a, b: F.when(a == b, F.lit("unchanged")).otherwise(F.lit("changed"))
    return (
        F.when(known.isNull(), F.lit("new"))
        .when(prev_etag.isNotNull() & etag.isNotNull(), verdict(prev_etag, etag))
        .when(prev_modified.isNotNull() & modified.isNotNull(), verdict(prev_modified, modified))
        .when(prev_hash.isNotNull() & now_hash.isNotNull(), verdict(prev_hash, now_hash))
        .otherwise(F.lit("unknown"))
    )
