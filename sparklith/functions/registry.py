"""Kernels by signature: an operator's name with the roles of its operands.

A kernel makes a ``Column`` from ``Column`` operands, so what users register is planned and compiled like all else; a
vectorised UDF applied to columns is such a kernel, too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import row_hash
from .types import ASSIGN_PAIRS, PAIRS, SPARK_TYPE


@dataclass(frozen=True)
class Signature:
    """Equal if the name and the operands' roles, in order, are equal."""

    name: str
    operands: tuple[str, ...]

    @classmethod
    def of(cls, name: str, *operands: str) -> Signature:
        return cls(name, operands)


@dataclass(frozen=True)
class Kernel:
    build: Callable[..., Column]
    result: str


@dataclass
class Registry:
    """Registered kernels; ``register`` replaces what was there."""

    kernels: dict[Signature, Kernel] = field(default_factory=dict)

    def register(self, signature: Signature, build: Callable[..., Column], result: str) -> None:
        if result not in SPARK_TYPE:
            raise ValueError(f"unknown role {result}")
        self.kernels[signature] = Kernel(build, result)

    def find(self, name: str, *operands: str) -> Kernel:
        try:
            return self.kernels[Signature(name, operands)]
        except KeyError:
            raise ValueError(f"no kernel {name} for {', '.join(operands)}") from None

    def apply(self, name: str, columns: list[Column], roles: list[str]) -> tuple[Column, str]:
        kernel = self.find(name, *roles)
        return kernel.build(*columns), kernel.result


def _num(col: Column, role: str) -> Column:
    return col.cast("bigint") if role == "bool" else col


def _binary(op: Callable[[Column, Column], Column], a: str, b: str) -> Callable[[Column, Column], Column]:
    return lambda x, y: op(_num(x, a), _num(y, b))


def _add(a: str, b: str, kind: T.DataType) -> Callable[[Column, Column], Column]:
    return lambda x, y: (_num(x, a) + _num(y, b)).cast(kind) if b == "bool" else _num(x, a) + _num(y, b)


def default_registry() -> Registry:
    """All built-in kernels: ``+ += = > >= hash= hash+=``. ``+=`` is what an addition onto an expression is."""
    out = Registry()
    for a, b in PAIRS:
        out.register(Signature.of("+", a, b), _add(a, b, SPARK_TYPE[a]), a)
        for name, op in (("=", lambda x, y: x == y), (">", lambda x, y: x > y), (">=", lambda x, y: x >= y)):
            out.register(Signature.of(name, a, b), _binary(op, a, b), "bool")
    for a, b in ASSIGN_PAIRS:
        out.register(Signature.of("+=", a, b), _add(a, b, SPARK_TYPE[a]), a)
    out.register(Signature.of("=", "str", "str"), lambda x, y: x == y, "bool")
    for a in SPARK_TYPE:
        out.register(Signature.of("hash=", a), row_hash, "u64")
        out.register(Signature.of("hash+=", "u64", a), lambda h, c: F.when(h.isNotNull() & c.isNotNull(), F.xxhash64(h, c)), "u64")
    return out


def kernel_from_udf(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A vectorised UDF as a kernel."""
    return lambda *columns: udf(*columns)
