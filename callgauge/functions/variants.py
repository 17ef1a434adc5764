"""SQL expression texts over JSON and Variant values.

The helpers give expression text, so that rules read as the SQL they are. They
are kept short on purpose: whole-stage code is one method, and the JVM does not
compile methods above 8000 bytes of bytecode.
"""

from __future__ import annotations

# First three letters of ``schema_of_variant`` per JSON type.
NUMBER = "('BIG', 'DEC', 'DOU', 'FLO')"
KINDS = {
    "string": "array('STR')",
    "integer": f"array{NUMBER}",
    "number": f"array{NUMBER}",
    "boolean": "array('BOO')",
    "array": "array('ARR')",
    "object": "array('OBJ')",
}


def kind(value: str) -> str:
    """JSON type of a Variant: STR, BIG, DEC, DOU, FLO, BOO, ARR, OBJ or VOI; NULL for no Variant."""
    return f"left(schema_of_variant({value}), 3)"


def kind_of_json(text: str) -> str:
    """The same from the JSON text of a value, told by its first sign; every number is BIG."""
    signs = {'"': "STR", "{": "OBJ", "[": "ARR", "t": "BOO", "f": "BOO", "n": "VOI"}
    return f"CASE left({text}, 1) " + " ".join(f"WHEN '{sign}' THEN '{name}'" for sign, name in signs.items()) + f" ELSE if({text} IS NULL, NULL, 'BIG') END"


def kinds_of_type(name: str) -> str:
    """The kinds a parameter type takes; NULL for a type that is not checked."""
    return f"CASE {name} " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in KINDS.items()) + " END"


def python_type(full: str) -> str:
    """The type name used in messages, from a ``schema_of_variant`` text."""
    return (
        f"CASE WHEN {full} LIKE 'DECIMAL%' AND {full} NOT LIKE '%,0)' THEN 'float'"
        f" ELSE CASE left({full}, 3) WHEN 'STR' THEN 'str' WHEN 'BIG' THEN 'int' WHEN 'DEC' THEN 'int'"
        " WHEN 'DOU' THEN 'float' WHEN 'FLO' THEN 'float' WHEN 'BOO' THEN 'bool' WHEN 'ARR' THEN 'list'"
        " WHEN 'OBJ' THEN 'dict' ELSE 'NoneType' END END"
    )


def comparable(value: str, tag: str) -> str:
    """Text that is equal for equal values: numbers and booleans by value, the rest as JSON."""
    return (
        f"CASE WHEN {tag} IN {NUMBER} THEN concat('#', try_cast(to_json({value}) AS DOUBLE))"
        f" WHEN {tag} = 'BOO' THEN if(to_json({value}) = 'true', '#1.0', '#0.0')"
        f" ELSE to_json({value}) END"
    )


def key_path(name: str) -> str:
    """Path of a top-level key for ``try_variant_get``; keys may hold dots and spaces."""
    return f"""CASE WHEN contains({name}, '"') THEN concat("$['", {name}, "']") ELSE concat('$["', {name}, '"]') END"""


def quoted_list(items: str) -> str:
    """``['a', 'b']`` as shown in messages."""
    return f"""CASE WHEN size({items}) > 0 THEN concat("['", array_join({items}, "', '"), "']") ELSE '[]' END"""
