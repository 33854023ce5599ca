"""String functions with the reference's semantics; a null argument gives null unless said otherwise."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def byte_length(s: Column) -> Column:
    """LENGTH: bytes of the UTF-8 text."""
    return F.octet_length(s)


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(n, F.lit(0)).cast("int"))


def compare(a: Column, b: Column) -> Column:
    """STRCMP: -1, 0 or 1, byte by byte."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def pad_equal(a: Column, b: Column) -> Column:
    """Equality that ignores trailing spaces."""
    return F.rtrim(a) == F.rtrim(b)


def sounds_like(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


def field(x: Column, *values: Column) -> Column:
    """FIELD: place of the first value equal to x, from 1; 0 where there is none or x is null."""
    chain = F.when(x == values[0], 1)
    for i, v in enumerate(values[1:], 2):
        chain = chain.when(x == v, i)
    return chain.otherwise(0)


def elt(i: Column, *values: Column) -> Column:
    """ELT: the i-th value, from 1; null beyond them."""
    chain = F.when(i == 1, values[0])
    for k, v in enumerate(values[1:], 2):
        chain = chain.when(i == k, v)
    return chain


def make_set(bits: Column, *values: Column) -> Column:
    """MAKE_SET: the values whose bit is set, with commas; null values are left out."""
    chosen = [F.when(bits.cast("bigint").bitwiseAND(F.lit(1 << i)) != 0, v) for i, v in enumerate(values)]
    return F.when(bits.isNotNull(), F.concat_ws(",", *chosen))


def export_set(bits: Column, on: str, off: str, separator: str = ",", n: int = 64) -> Column:
    """EXPORT_SET: ``on`` or ``off`` for each of the lowest n bits, the lowest first."""
    parts = [F.when(F.call_function("shiftrightunsigned", bits.cast("bigint"), F.lit(i)).bitwiseAND(F.lit(1)) == 1, on).otherwise(off) for i in range(min(n, 64))]
    return F.when(bits.isNotNull(), F.concat_ws(separator, *parts))


def insert(s: Column, at: int, length: int, new: Column) -> Column:
    """INSERT(s, at, length, new): ``length`` characters from ``at`` replaced; outside the text nothing changes."""
    done = F.concat(F.substring(s, 1, at - 1), new, s.substr(F.lit(at + length), F.char_length(s)))
    return F.when((F.lit(at) >= 1) & (F.lit(at) <= F.char_length(s)), done).otherwise(s)


def inet_aton(s: Column) -> Column:
    """INET_ATON: the number of a dotted address of four bytes; anything else gives null."""
    p = F.split(s, r"\.")
    number = sum((p.getItem(i).try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), p.getItem(0).try_cast("bigint") * 256**3)
    fits = s.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") & F.forall(p, lambda x: x.try_cast("int") <= 255)
    return F.when(fits, number)


def inet_ntoa(n: Column) -> Column:
    return F.concat_ws(".", *(F.call_function("shiftrightunsigned", n.cast("bigint"), F.lit(8 * i)).bitwiseAND(F.lit(255)).cast("string") for i in (3, 2, 1, 0)))


#: POSIX classes and the Java classes of the same content.
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s",
    "blank": r"\p{Blank}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}",
}


def posix_pattern(pattern: str) -> str:
    """A POSIX pattern for Java's engine: bracket classes and word boundaries translated."""
    pattern = pattern.replace("[[:<:]]", r"\b").replace("[[:>:]]", r"\b")
    return re.sub(r"\[:(\w+):\]", lambda m: POSIX[m.group(1)], pattern)


def regexp(s: Column, pattern: str, fold: bool = True) -> Column:
    """REGEXP: whether a part of s matches; without regard to case unless ``fold`` is off."""
    return s.rlike(("(?i)" if fold else "") + posix_pattern(pattern))


def number_prefix(s: Column) -> Column:
    """A text in numeric context: its leading number, or 0."""
    lead = F.regexp_extract(F.ltrim(s), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.when(s.isNotNull(), F.coalesce(lead.try_cast("double"), F.lit(0.0)))


def convert_charset(s: Column, charset: str) -> Column:
    """CONVERT(s USING charset), read back as text: characters the set lacks become '?'."""

    @F.pandas_udf("string")
    def through(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode(charset, "replace").decode(charset))

    return through(s)


@F.pandas_udf(BinaryType())
def compress(texts: pd.Series) -> pd.Series:
    """COMPRESS: length in four bytes, the least first, then a zlib stream; of the empty text nothing."""
    return texts.map(lambda t: None if t is None else b"" if t == "" else (len(b := t.encode()) & 0x3FFFFFFF).to_bytes(4, "little") + zlib.compress(b))


@F.pandas_udf(StringType())
def uncompress(data: pd.Series) -> pd.Series:
    """UNCOMPRESS; null for what isn't compressed."""

    def one(b: bytes | None) -> str | None:
        if b is None or b == b"":
            return None if b is None else ""
        try:
            return zlib.decompress(bytes(b)[4:]).decode("utf-8", "replace")
        except zlib.error:
            return None

    return data.map(one)


def uncompressed_length(b: Column) -> Column:
    """UNCOMPRESSED_LENGTH: what the first four bytes say."""
    h = F.hex(b)
    return F.when(F.octet_length(b) < 4, 0).otherwise(F.conv(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("bigint"))


def extract_value(xml: Column, path: str) -> Column:
    """EXTRACTVALUE: the texts that match, with spaces between."""
    return F.concat_ws(" ", F.call_function("xpath", xml, F.lit(path if path.endswith("text()") else path + "/text()")))


def update_xml(xml: Column, path: str, new: str) -> Column:
    """UPDATEXML: the one element at ``path`` (steps of names from the root) replaced by ``new``.

    As it is where none or several match or the text isn't XML.
    """
    steps = [s for s in path.split("/") if s]

    @F.pandas_udf("string")
    def through(texts: pd.Series) -> pd.Series:
        from xml.etree import ElementTree as E

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                root = E.fromstring(t)
            except E.ParseError:
                return t
            if root.tag != steps[0]:
                return t
            if len(steps) == 1:
                return new
            inner = steps[1:]
            parents = root.findall("/".join(inner[:-1])) if inner[:-1] else [root]
            hits = [(p, c) for p in parents for c in p if c.tag == inner[-1]]
            if len(hits) != 1:
                return t
            parent, child = hits[0]
            text = E.tostring(child, encoding="unicode", short_empty_elements=False)
            text = text[: len(text) - len(child.tail or "")] if child.tail else text
            return t.replace(text, new, 1) if text in t else t

        return texts.map(one)

    return through(xml)
