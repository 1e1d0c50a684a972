"""Strict JSON text -> VARIANT, plus the type tests validation needs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# Characters stripped from both ends of a line (the white space Python's
# str.strip removes, ASCII and Latin-1 range).
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# A later duplicate of an object key replaces the earlier one.
DUPLICATE_KEYS_CONF = "spark.sql.variant.allowDuplicateKeys"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def with_document(df: DataFrame, raw: str = "raw", doc: str = "doc") -> DataFrame:
    """Add `doc`, the VARIANT read from `raw`; NULL where `raw` is not one JSON value.

    `try_parse_json` alone stops after the first value and ignores what follows,
    so the text is parsed as the only element of an array: trailing text then
    breaks the parse or shows up as a second element. Only text holding `]` could
    close that array early, so only such text is parsed once more, as a field.
    """
    df.sparkSession.conf.set(DUPLICATE_KEYS_CONF, "true")
    text = F.col(raw)
    wrapped = df.withColumn("_wrapped", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    one_value = F.try_variant_get("_wrapped", "$[1]", "variant").isNull()
    not_closed_early = ~text.contains("]") | F.try_parse_json(
        F.concat(F.lit('{"w":'), text, F.lit("}"))
    ).isNotNull()
    return wrapped.withColumn(
        doc,
        F.when(one_value & not_closed_early, F.try_variant_get("_wrapped", "$[0]", "variant")),
    ).drop("_wrapped")


def is_object_text(raw: Column) -> Column:
    """For text known to be valid JSON: is the value an object?"""
    return F.ltrim(raw, F.lit(BLANKS)).startswith("{")


class Field(NamedTuple):
    """One top-level field: its JSON type (NULL if absent), its text, the value itself."""

    kind: Column
    text: Column
    value: Column


def with_fields(df: DataFrame, names: tuple[str, ...], doc: str = "doc") -> DataFrame:
    """Add the columns `field` names; each field is looked up once."""
    found = df.select(
        "*", *(F.try_variant_get(doc, f"$.{n}", "variant").alias(f"_{n}_value") for n in names)
    )
    return found.select(
        "*",
        *(F.schema_of_variant(f"_{n}_value").alias(f"_{n}_kind") for n in names),
        *(F.col(f"_{n}_value").try_cast("string").alias(f"_{n}_text") for n in names),
    )


def field(name: str) -> Field:
    return Field(*(F.col(f"_{name}_{part}") for part in Field._fields))


def is_present(f: Field) -> Column:
    """The field is there and not JSON null."""
    return F.coalesce(f.kind != "VOID", F.lit(False))


def is_string(f: Field) -> Column:
    return F.coalesce(f.kind == "STRING", F.lit(False))


def is_boolean(f: Field) -> Column:
    return F.coalesce(f.kind == "BOOLEAN", F.lit(False))


def is_number(f: Field) -> Column:
    kind = f.kind
    return F.coalesce(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False)
    )


def is_nested(f: Field) -> Column:
    kind = f.kind
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))


def as_written(name: str, raw: str = "raw") -> Column:
    """A top-level number's text as it stands in the document.

    Of the numbers that follow this name anywhere in it, the last that has the field's
    value; where none has (the name is written with escapes), the value's own text.
    """
    f = field(name)
    value = f.value.try_cast("double")
    found = F.regexp_extract_all(F.col(raw), F.lit(f'"{name}"\\s*:\\s*(-?[0-9][0-9.eE+-]*)'))
    same = F.filter(found, lambda x: x.try_cast("double") == value)
    return F.coalesce(F.try_element_at(same, F.lit(-1)), f.text)


def shown(f: Field, name: str | None = None) -> Column:
    """How a value is quoted inside an error message; the numbers of field `name` as written."""
    text = f.text if name is None else F.when(is_number(f), as_written(name)).otherwise(f.text)
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(char), F.lit(code))
    quoted = (
        F.when(~text.contains("'"), F.concat(F.lit("'"), escaped, F.lit("'")))
        .when(~text.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )
    return (
        F.when(is_string(f), quoted)
        .when(is_boolean(f), F.initcap(text))
        .otherwise(F.coalesce(text, F.lit("None")))
    )


def key_text(name: str) -> Column:
    """Text stored for a key field: numbers as written, booleans as 1/0."""
    f = field(name)
    return F.when(is_number(f), as_written(name)).when(
        is_boolean(f), F.when(f.text == "true", F.lit("1")).otherwise(F.lit("0"))
    ).otherwise(f.text)


def canonical(doc: Column) -> Column:
    """The document as text with sorted keys, without insignificant space."""
    return F.to_json(doc)


# Possessive throughout: read in a loop, whatever the length.
_INNER = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_NUMBER = r"-?[0-9][0-9.eE+-]*+"


def canonical_text(raw: Column) -> Column:
    """As `canonical`, for text known to be valid JSON, with all numbers as they are written.

    Strings and numbers go through VARIANT as strings that begin with `s` and `n`. In its
    output a quote that opens a string is the only one without a backslash before it and
    with such a letter behind it.
    """
    strings = F.regexp_replace(raw, F.lit(f'"({_INNER})"'), F.lit('"s$1"'))
    marked = F.regexp_replace(
        strings, F.lit(f'\\G((?:[^"0-9-]++|"{_INNER}")*+)({_NUMBER})'), F.lit('$1"n$2"')
    )
    text = F.to_json(F.try_parse_json(marked))
    plain = F.regexp_replace(text, F.lit(f'(?<!\\\\)"n({_NUMBER})"'), F.lit("$1"))
    return F.regexp_replace(plain, F.lit(r'(?<!\\)"s'), F.lit('"'))


def with_canonical(df: DataFrame, raw: str = "raw") -> DataFrame:
    """`raw` in canonical form where it is JSON, else as it stands."""
    doc = "_" * (1 + max(len(c) for c in df.columns))
    text = F.when(F.col(doc).isNotNull(), canonical_text(F.col(raw)))
    return with_document(df, raw, doc).withColumn(raw, F.coalesce(text, F.col(raw))).drop(doc)
