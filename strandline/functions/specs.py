"""Compression spec strings: parse, validate, flatten, look up.

Grammar: ``n`` none; ``z[:level]`` or ``z:{level[,variant][,bits]}``; ``e:{key,iv,spec}``; ``c[:{n}]``; ``g[:{level}]``;
``b:spec``, ``b:size=spec`` or ``b:{size[*count]=spec,...}`` with at most one ``*`` block in braces. Sizes may end
in K or M. A tree comes out flat: one row for each node, with its path from the root.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER, _WORD, _HEX = re.compile(r"[0-9]+"), re.compile(r"[0-9A-Za-z]*"), re.compile(r"[0-9A-Fa-f]*")
# The kinds by their letter, and the variants of z.
KINDS = {"n": "None", "z": "ZLib", "e": "Encrypted", "b": "BlockTable", "c": "BCPack", "g": "GDeflate"}
VARIANTS = ("mpq", "zlib", "lz4hc")

NODE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("size", T.LongType()), T.StructField("count", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("variant", T.StringType()), T.StructField("bits", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("iv", T.StringType())]
)


class SpecError(ValueError):
    """A string outside the grammar."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.nodes = text, 0, []

    def see(self) -> str:
        return self.text[self.at : self.at + 1]

    def eat(self, want: str) -> None:
        if self.see() != want:
            raise SpecError(f"{want!r} expected at {self.at}")
        self.at += 1

    def may(self, want: str) -> bool:
        if self.see() == want:
            self.at += 1
            return True
        return False

    def take(self, rx: re.Pattern) -> str:
        m = rx.match(self.text, self.at)
        if not m:
            raise SpecError(f"a number expected at {self.at}")
        self.at = m.end()
        return m[0]

    def number(self, low: int = 0, high: int = (1 << 64) - 1) -> int:
        n = int(self.take(_NUMBER))
        if not low <= n <= high:
            raise SpecError(f"{n} is out of range")
        return n

    def size(self) -> tuple[int, int | None]:
        """Size and count; a count of None after ``*`` means the rest, and one is 1."""
        n = self.number()
        if self.see() in ("K", "M"):
            n *= {"K": 1 << 10, "M": 1 << 20}[self.see()]
            self.at += 1
        elif self.see() in ("G", "T", "P"):
            raise SpecError("a unit is K or M")
        if not self.may("*"):
            return n, 1
        return n, self.number(high=(1 << 32) - 1) if self.see().isdigit() else None

    def node(self, path: str, size=None, count=None, **more) -> int:
        base = dict.fromkeys(NODE.names) | {"path": path, "size": size, "count": count} | more
        self.nodes.append(base)
        return len(self.nodes) - 1

    def spec(self, path: str, size=None, count=None) -> None:
        letter = self.see()
        if letter not in KINDS or not letter:
            raise SpecError(f"no spec starts with {letter!r}")
        self.at += 1
        me = self.nodes[self.node(path, size, count, kind=KINDS[letter])]
        if letter == "z" and self.may(":"):
            braced = self.may("{")
            if self.see().isdigit():
                me["level"] = self.number(1, 9)
            elif not braced:
                raise SpecError("a level expected")
            if braced:
                if self.may(","):
                    if not self.see().isdigit():
                        me["variant"] = self.take(_WORD)
                        if me["variant"] not in VARIANTS:
                            raise SpecError("unknown variant")
                        if self.may(","):
                            me["bits"] = self.number(8, 15)
                    else:
                        me["bits"] = self.number(8, 15)
                self.eat("}")
        elif letter == "e":
            self.eat(":")
            self.eat("{")
            me["key"] = self.take(_WORD)
            self.eat(",")
            me["iv"] = self.take(_HEX)
            self.eat(",")
            if len(me["key"]) != 16 or len(me["iv"]) % 2 or not 2 <= len(me["iv"]) <= 16:
                raise SpecError("a key has 16 digits, a nonce one to eight bytes")
            self.spec(f"{path}.0")
            self.eat("}")
        elif letter in ("c", "g") and self.may(":"):
            self.eat("{")
            me["level"] = self.number(1, 7 if letter == "c" else 12)
            self.eat("}")
        elif letter == "b":
            self.eat(":")
            if self.may("{"):
                stars = k = 0
                while True:
                    if self.may("*"):
                        stars += 1
                        if stars > 1:
                            raise SpecError("more than one * block")
                        n, c = (None, None) if self.see() == "=" else (0, self.number(high=(1 << 32) - 1))
                    else:
                        n, c = self.size()
                    self.eat("=")
                    self.spec(f"{path}.{k}", n, c)
                    k += 1
                    if not self.may(","):
                        break
                self.eat("}")
            elif self.see().isdigit() or self.see() == "*":
                n, c = (None, None) if self.may("*") else self.size()
                self.eat("=")
                self.spec(f"{path}.0", n, c)
            else:
                self.spec(f"{path}.0")


def parse(text: str) -> list[dict]:
    """The nodes of a spec, the root first."""
    r = _Reader(text)
    r.spec("0")
    if r.at != len(text):
        raise SpecError(f"unexpected text at {r.at}")
    return r.nodes


def valid(text: str) -> bool:
    """FLT-45."""
    try:
        parse(text)
    except SpecError:
        return False
    return True


@lru_cache(maxsize=4096)
def _or_none(text):
    try:
        return None if text is None else [tuple(n.values()) for n in parse(text)]
    except SpecError:
        return None


def unpack_by_spec(data: bytes, spec: str) -> bytes:
    """SCL-45: patch data unpacked as its spec says: as it is, one deflated stream, or blocks of either by size.

    A block's size counts packed bytes; one without a size takes the rest, and a size beyond the end is cut to it.
    """
    nodes = {n["path"]: n for n in parse(spec)}

    def one(path: str, part: bytes) -> bytes:
        kind = nodes[path]["kind"]
        if kind == "None":
            return part
        if kind == "ZLib":
            return zlib.decompress(part)
        raise SpecError(f"patch data cannot be packed by {kind}")

    if nodes["0"]["kind"] != "BlockTable":
        return one("0", data)
    out, at, k = [], 0, 0
    while f"0.{k}" in nodes and at < len(data):
        n = nodes[f"0.{k}"]
        end = len(data) if n["size"] is None else min(len(data), at + n["size"] * (n["count"] or 1))
        out.append(one(f"0.{k}", data[at:end]))
        at, k = end, k + 1
    return b"".join(out)


def nodes_column(spec: Column) -> Column:
    """SCL-19, 20, 44: array of nodes; null for a string outside the grammar."""
    return F.udf(_or_none, T.ArrayType(NODE), useArrow=True)(spec)


def valid_column(spec: Column) -> Column:
    """FLT-45."""
    return F.udf(lambda s: _or_none(s) is not None, T.BooleanType(), useArrow=True)(spec)


def kind(spec: Column) -> Column:
    """SCL-21: name of a spec's outermost kind, from its first letter."""
    out = F.lit(None).cast("string")
    for letter, name in KINDS.items():
        out = F.when(F.substring(spec, 1, 1) == letter, F.lit(name)).otherwise(out)
    return out


def is_encrypted(spec: Column) -> Column:
    """FLT-43: is the outermost kind an encryption?"""
    return F.coalesce(spec.startswith("e:"), F.lit(False))


def is_compressed(nodes: Column) -> Column:
    """FLT-44: is any node a compression?"""
    return F.coalesce(F.exists(nodes, lambda n: n["kind"].isin("ZLib", "BCPack", "GDeflate")), F.lit(False))
