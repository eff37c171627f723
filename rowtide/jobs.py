"""Typed job arguments: a dataclass as a schema, and as a command line.

Fields may be str, int, float, bool (with a default), lists and optionals of them, Literal choices, paths, and
nested dataclasses, which become groups of options with names of their own.
"""

from __future__ import annotations

import argparse
import dataclasses
import pathlib
import types
import typing
from collections.abc import Sequence

from pyspark.sql import types as T

_KINDS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), pathlib.Path: T.StringType(), bytes: T.BinaryType()}


def _plain(kind) -> tuple[object, bool]:
    """A type without ``None``, and whether that was allowed."""
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        own = [k for k in typing.get_args(kind) if k is not type(None)]
        if len(own) != 1:
            raise ValueError(f"a union of several types: {kind}")
        return own[0], True
    return kind, False


def struct_of(cls: type) -> T.StructType:
    """The schema of a dataclass."""

    def one(kind):
        kind, null = _plain(kind)
        if dataclasses.is_dataclass(kind):
            return struct_of(kind), null
        if typing.get_origin(kind) is list:
            element, empty = one(typing.get_args(kind)[0])
            return T.ArrayType(element, empty), null
        if typing.get_origin(kind) is typing.Literal:
            return _KINDS[type(typing.get_args(kind)[0])], null
        if kind not in _KINDS:
            raise ValueError(f"no column type for {kind}")
        return _KINDS[kind], null

    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, *one(hints[f.name])) for f in dataclasses.fields(cls)])


def _add(parser, cls: type, seen: set[str], nested: bool) -> None:
    hints = typing.get_type_hints(cls)
    for f in dataclasses.fields(cls):
        kind, null = _plain(hints[f.name])
        if f.name in seen:
            raise ValueError(f"two fields are named {f.name}")
        seen.add(f.name)
        if dataclasses.is_dataclass(kind):
            _add(parser.add_argument_group(f.name), kind, seen, True)
            continue
        default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else None if null else dataclasses.MISSING
        flag = "--" + f.name.replace("_", "-")
        if kind is bool:
            if default is dataclasses.MISSING:
                raise ValueError(f"{f.name}: a bool needs a default")
            parser.add_argument(flag, dest=f.name, action=argparse.BooleanOptionalAction, default=default)
            continue
        options: dict = {}
        if typing.get_origin(kind) is list:
            kind, options = typing.get_args(kind)[0], {"nargs": "*"}
        elif typing.get_origin(kind) is typing.Literal:
            options = {"choices": typing.get_args(kind)}
            kind = type(options["choices"][0])
        elif typing.get_origin(kind) is not None:
            raise ValueError(f"{f.name}: {kind} is not supported")
        if default is dataclasses.MISSING:
            if nested:
                raise ValueError(f"{f.name}: a nested field needs a default")
            parser.add_argument(f.name, type=kind, **options)
        else:
            parser.add_argument(flag, dest=f.name, type=kind, default=default, **options)


def _build(cls: type, found: dict):
    hints = typing.get_type_hints(cls)
    return cls(**{f.name: _build(k, found) if dataclasses.is_dataclass(k := _plain(hints[f.name])[0]) else found[f.name] for f in dataclasses.fields(cls)})


def parse(cls: type, argv: Sequence[str] | None = None):
    """An instance of a dataclass from a command line: fields without a default are positional."""
    parser = argparse.ArgumentParser(description=cls.__doc__)
    _add(parser, cls, set(), False)
    return _build(cls, vars(parser.parse_args(argv)))
