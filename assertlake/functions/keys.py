"""Identity keys and the white-space rules that they rest on. Column in, column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: What Unicode-aware regular expressions take as white space; fixed values.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column | str) -> Column:
    """null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(F.translate(text(c), SPACES, " " * len(SPACES)), "  +", " ")


def strip(c: Column | str) -> Column:
    return F.btrim(text(c), F.lit(SPACES))


def squeezed(c: Column | str) -> Column:
    """collapse and strip."""
    return F.trim(collapse(c))


def without_space(c: Column | str) -> Column:
    return F.translate(text(c), SPACES, "")


def uncommented(c: Column | str, block_first: bool = False) -> Column:
    """// and /* */ comments become a space each."""
    line = lambda x: F.regexp_replace(x, r"//[^\n]*", " ")
    block = lambda x: F.regexp_replace(x, r"(?s)/\*.*?\*/", " ")
    return line(block(text(c))) if block_first else block(line(text(c)))


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def body_hash(c: Column | str) -> Column:
    return digest(squeezed(c))


def body_hash_ci(c: Column | str) -> Column:
    return digest(F.lower(squeezed(c)))


def canon_hash(c: Column | str) -> Column:
    """Empty for empty text."""
    bare = F.lower(without_space(c))
    return F.when(bare == "", "").otherwise(F.substring(F.md5(bare), 1, 16))


def sample_hash(nl: Column | str, sva: Column | str) -> Column:
    return digest(F.concat(strip(nl), F.lit("|||"), strip(sva)))


def audit_hash(c: Column | str) -> Column:
    """Of the text without comments; empty for empty text."""
    bare = squeezed(uncommented(c, block_first=True))
    return F.when(bare == "", "").otherwise(digest(bare))


def json_string(c: Column | str) -> Column:
    return F.to_json(F.struct(text(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(text(c).alias("x")))) - 6)


def row_hash(given: list[str], nl: str, rtl: str, sva: str) -> Column:
    """The first of the given columns that isn't empty, else a digest of the three texts as JSON with sorted keys."""
    known = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in given)) if given else F.lit(None).cast("string")
    body = F.concat(F.lit('{"nl": '), json_string(nl), F.lit(', "rtl": '), json_string(rtl), F.lit(', "sva": '), json_string(sva), F.lit("}"))
    return F.coalesce(known, digest(body))


def raw_hash(c: Column | str) -> Column:
    return digest(text(c))


def partial_hash(c: Column | str) -> Column:
    """White space collapsed but not stripped."""
    return digest(collapse(c))


def identities(df: DataFrame, body: str, other: str) -> DataFrame:
    """df's body under all keys of one text; white space is collapsed once for all of them. other goes beside it in sample_hash and cache_key."""
    c = "__collapsed"
    rows = df.withColumn(c, collapse(body))
    bare = F.lower(F.translate(c, " ", ""))
    return rows.select(
        *df.columns, digest(F.trim(c)).alias("body_hash"), digest(F.lower(F.trim(c))).alias("body_hash_ci"), F.when(bare == "", "").otherwise(F.substring(F.md5(bare), 1, 16)).alias("canon_hash"),
        sample_hash(other, body).alias("sample_hash"), raw_hash(body).alias("raw_hash"), digest(F.col(c)).alias("partial_hash"), cache_key(body, other).alias("cache_key"),
        digest(F.concat(F.trim(c), F.lit("|||"), squeezed(other))).alias("cache_key_normalised"),
    ).drop(c)


def cache_key(sva: Column | str, rtl: Column | str, normalised: bool = False) -> Column:
    own = squeezed if normalised else text
    return digest(F.concat(own(sva), F.lit("|||"), own(rtl)))


def bucket(key: Column, n: int = 1000) -> Column:
    """A 16-digit hexadecimal key as a number modulo n; such numbers pass a bigint."""
    return F.pmod(F.conv(key, 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")
