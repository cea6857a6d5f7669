"""Helpers shared by the operators that read texts in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Code points that Unicode made letters or digits after the version that the tokenizer libraries
# follow.  For them these are neither, while ``regex`` knows them.
LATE = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()


_BASIC = 0x10000


def _members(category: str) -> str:
    """The code points of a class below U+10000 as ranges that can stand in a bracket expression."""
    late = regex.compile(_late_class())
    every = late.sub("\x01", "".join(map(chr, [*range(0xD800), *range(0xE000, _BASIC)])))
    runs = [m.group() for m in regex.finditer(category + "+", every)]
    return "".join(re.escape(r[0]) + ("-" + re.escape(r[-1]) if len(r) > 1 else "") for r in runs)


def _late_class() -> str:
    return "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATE) + "]"


def _spelled_out(pattern: str) -> str:
    r"""``pattern`` with the members of \p{L}, \p{N}, \s and \S written down, for the standard module."""
    out, bracket, i = [], False, 0
    while i < len(pattern):
        for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
            if pattern.startswith(name, i):
                if name == r"\S" and bracket:
                    raise ValueError("\\S inside a bracket is not supported")
                members = _members(name.lower() if name == r"\S" else name)
                out.append(members if bracket else f"[{'^' * (name == chr(92) + 'S')}{members}]")
                i += len(name)
                break
        else:
            if pattern[i] == "\\":
                out.append(pattern[i:i + 2])
                i += 2
                continue
            bracket = (bracket or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


def splitter(pattern: str):
    """All matches of ``pattern`` from left to right, with the libraries' letters and digits.

    Texts without code points above U+FFFF are cut by the standard module, which is faster; the others by ``regex``.
    """
    quick, find, late = re.compile(_spelled_out(pattern)), regex.compile(pattern), regex.compile(_late_class())

    def split(text: str) -> list[str]:
        if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return quick.findall(text)
        plain = late.sub("\x01", text)  # neither letter nor digit nor space
        return [text[m.start():m.end()] for m in find.finditer(plain)]

    return split


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``text`` under names of our own, so that no other column of the table can clash."""
    return df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))


def map_rows(df: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for a function from the columns of one batch to the columns of another."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(*batch.columns)
            yield pa.RecordBatch.from_arrays(
                [c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow)],
                schema=arrow)

    return df.mapInArrow(run, schema)
