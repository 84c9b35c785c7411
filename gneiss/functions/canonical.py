"""A cell's canonical text, its comparable value, its length, and what kind of characters it has. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What trimming takes: every character up to U+0020.
TRIMMED = "".join(map(chr, range(33)))
DECIMAL = "decimal(38,18)"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def strip_zeros(text: Column) -> Column:
    """Of a plain decimal text: no trailing zeros after the point, no bare point."""
    return F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def double_text(c: Column) -> Column:
    """The shortest text that reads back as the number, without exponent where decimal(38,18) holds it exactly; NaN and infinities by name."""
    text = c.cast("string")
    exact = text.try_cast(DECIMAL)
    return F.when(exact.isNotNull() & (exact.cast("double") == c.cast("double")), strip_zeros(exact.cast("string"))).otherwise(text)


def timestamp_text(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.instr(text, ".") > 0, text).otherwise(F.concat(text, F.lit(".0")))


def canonical(c: Column, kind: T.DataType, trim_strings: bool = True) -> Column:
    if isinstance(kind, T.StringType):
        return trim(c) if trim_strings else c
    if isinstance(kind, T.DecimalType):
        return strip_zeros(c.cast("string"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return double_text(c)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return timestamp_text(c)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("<binary:"), F.octet_length(c).cast("string"), F.lit(">"))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c)
    text = c.cast("string")
    return text if isinstance(kind, T.IntegralType | T.DateType | T.BooleanType) or not trim_strings else trim(text)


def utf16_length(c: Column) -> Column:
    """UTF-16 units; ASCII needs no encoding to know."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")).cast("long")


def is_semantic_null(c: Column, tokens: tuple[str, ...]) -> Column:
    return F.upper(trim(c)).isin(*tokens) if tokens else F.lit(False)


# Kinds of characters, in order of precedence; private-use marks stand for them on the way.
_OTHER = r"[^\p{javaDigit}\p{IsHan}\p{javaLetter}\p{javaWhitespace}\-_/.:@#]"
_DIGIT, _HAN, _LETTER, _SPACE, _SPECIAL = map(chr, range(0xE000, 0xE005))
_NAMES = ((_DIGIT, "D"), (_HAN, "C"), (_LETTER, "L"), (_SPACE, "W"), (_SPECIAL, "S"))


def pattern(c: Column) -> Column:
    """Runs of digits, Han, letters, white space and specials as D3, C2, L1, W1, S1; - _ / . : @ # stand for themselves; EMPTY for null or ''."""
    x = F.regexp_replace(c, _OTHER, _SPECIAL)
    for kind, mark in ((r"\p{javaDigit}", _DIGIT), (r"\p{IsHan}", _HAN), (r"\p{javaLetter}", _LETTER), (r"\p{javaWhitespace}", _SPACE)):
        x = F.regexp_replace(x, kind, mark)
    runs = F.regexp_extract_all(x, F.lit("(" + "|".join(f"{m}+" for m, _ in _NAMES) + r"|[\-_/.:@#])"), F.lit(1))

    def name(run: Column) -> Column:
        out = run
        for mark, letter in reversed(_NAMES):
            out = F.when(F.substring(run, 1, 1) == mark, F.concat(F.lit(letter), F.length(run).cast("string"))).otherwise(out)
        return out

    return F.when(c.isNull() | (c == ""), "EMPTY").otherwise(F.array_join(F.transform(runs, name), ""))


SHAPES = ("numeric_only", "alphabetic_only", "alphanumeric_only", "chinese_only", "contains_whitespace", "contains_special", "mixed")


def shapes(c: Column) -> dict[str, Column]:
    """The seven predicates on the kinds of characters that occur."""
    letter = r"(?:(?!\p{IsHan})(?!\p{javaDigit})\p{javaLetter})"
    digit, han, alpha = c.rlike(r"\p{javaDigit}"), c.rlike(r"(?!\p{javaDigit})\p{IsHan}"), c.rlike(letter)
    space = c.rlike(r"(?!\p{javaDigit})(?!\p{IsHan})(?!\p{javaLetter})\p{javaWhitespace}")
    special = c.rlike(r"[^\p{javaDigit}\p{IsHan}\p{javaLetter}\p{javaWhitespace}]")
    kinds = digit.cast("int") + alpha.cast("int") + han.cast("int") + space.cast("int") + special.cast("int")
    return {
        "numeric_only": digit & (kinds == 1), "alphabetic_only": alpha & (kinds == 1), "alphanumeric_only": digit & alpha & (kinds == 2), "chinese_only": han & (kinds == 1),
        "contains_whitespace": space, "contains_special": special, "mixed": kinds > 1,
    }


def hash60(c: Column, salt: str = "") -> Column:
    """60 bits of a text's md5, as SQL engines can compute alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 15), 16, 10).cast("long")
