"""Bytes to text by the charset's name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of charsets as content types have them, by the name of the table that they stand for.
SINGLE = {
    "latin-1": "iso-8859-1 latin1 latin-1 l1 iso8859-1 iso_8859-1 iso88591 binary", "cp1252": "windows-1252 cp1252 x-cp1252 ansi", "cp1250": "windows-1250 cp1250 x-cp1250", "cp1251": "windows-1251 cp1251 x-cp1251 win-1251",
    "cp1253": "windows-1253 cp1253", "cp1254": "windows-1254 cp1254", "cp1255": "windows-1255 cp1255", "cp1256": "windows-1256 cp1256", "cp1257": "windows-1257 cp1257", "cp1258": "windows-1258 cp1258",
    "iso8859-2": "iso-8859-2 iso8859-2 latin2 l2 iso_8859-2", "iso8859-3": "iso-8859-3 latin3", "iso8859-4": "iso-8859-4 latin4", "iso8859-5": "iso-8859-5 cyrillic", "iso8859-6": "iso-8859-6 arabic", "iso8859-7": "iso-8859-7 greek",
    "iso8859-8": "iso-8859-8 iso-8859-8-i hebrew", "iso8859-9": "iso-8859-9 latin5", "iso8859-10": "iso-8859-10 latin6", "iso8859-13": "iso-8859-13", "iso8859-14": "iso-8859-14", "iso8859-15": "iso-8859-15 latin9 latin-9", "iso8859-16": "iso-8859-16",
    "koi8-r": "koi8-r koi8", "koi8-u": "koi8-u", "cp866": "ibm866 cp866", "cp874": "windows-874 tis-620 iso-8859-11", "mac-roman": "macintosh mac x-mac-roman", "ascii": "us-ascii ascii",
}
MULTIPLE = {
    "gb18030": "gb18030 gbk gb2312 x-gbk gb_2312-80", "big5": "big5 big5-hkscs x-x-big5", "euc-jp": "euc-jp x-euc-jp", "cp932": "shift_jis shift-jis sjis windows-31j x-sjis", "iso2022-jp": "iso-2022-jp",
    "cp949": "euc-kr ks_c_5601-1987 windows-949 cp949", "utf-16": "utf-16 utf16", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be", "utf-32": "utf-32",
}
# End of the fixed values.


def upper_half(table: str) -> str:
    """The characters of a single-byte table's bytes from 128 on; U+FFFD where it has none, and control characters of those
    that the windows tables leave out."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(table))
        except UnicodeDecodeError:
            out.append(chr(b) if table.startswith("cp125") and b < 160 else "\ufffd")
    return "".join(out)


_LATIN = "".join(map(chr, range(128, 256)))
_BY_NAME = {name: table for table, names in MULTIPLE.items() for name in names.split()}


@F.arrow_udf(StringType())
def _decoded(body: pa.Array, name: pa.Array) -> pa.Array:
    return pa.array([None if b is None else b.decode(_BY_NAME[n], "replace").removeprefix("\ufeff") for b, n in zip(body.to_pylist(), name.to_pylist(), strict=True)], pa.string())


def decode_bytes(body: Column, name: Column) -> Column:
    """body as text by the charset of that name, in any case: UTF-8 where it is not known or null. What is no character of
    the charset becomes U+FFFD; null stays null.

    A byte of a single-byte charset is the Latin-1 character of its number, which a table turns into the charset's own, so
    these are decoded by built-in functions. Only bodies of the other charsets are handed to Python.
    """
    name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    tables = [(table, names.split()) for table, names in SINGLE.items()]
    chosen = F.when(name.isin(tables[0][1]), F.lit(upper_half(tables[0][0])))
    for table, names in tables[1:]:
        chosen = chosen.when(name.isin(names), F.lit(upper_half(table)))
    multiple = name.isin(list(_BY_NAME))
    whole = F.make_valid_utf8(body.cast("string"))
    return F.when(chosen.isNotNull(), F.call_function("translate", F.decode(body, "ISO-8859-1"), F.lit(_LATIN), chosen)).when(multiple, _decoded(F.when(multiple, body), name)).otherwise(F.regexp_replace(whole, r"^\x{FEFF}", ""))


def encode_text(text: Column, table: str) -> Column:
    """text as bytes of a single-byte table; a question mark for what it does not hold."""
    upper = upper_half(table).replace("\ufffd", "")
    fits = F.regexp_replace(text, f"[^\\x00-\\x7f{upper}]", "?")
    return F.encode(F.translate(fits, upper_half(table), _LATIN), "ISO-8859-1")
