"""Turtle and TriG files as quads.

Prefixes and blank-node labels hold for a document, so a file is read as a whole
by one task; many files are many tasks.  A task only writes a document's
statements out as N-Quads lines, which columns parse like any others.  Large
data belongs into N-Quads, whose files can be split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .rdf import parse_lines

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<text>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<node>_:\w(?:[\w-]|\.(?=[\w-]))*)
    |(?P<name>(?:[^\W\d_](?:[\w-]|\.(?=[\w-]))*)?:(?:[\w:%-]|\\.|\.(?=[\w:%\\-]))*)
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<word>[A-Za-z]+)
    |(?P<mark><<|>>|\^\^|[.;,\[\](){}])""",
    re.X | re.S,
)
_ESCAPE = {'"': '\\"', "\n": "\\n", "\r": "\\r"}


class _Document:
    """A document's statements; ``lines`` goes through it once."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.tokens = self._tokens(text)
        self.scope, self.base, self.prefixes, self.fresh, self.graph = scope, base, {}, 0, ""
        self.out: list[str] = []
        self.next()

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle: {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m.group()
        yield "end", ""

    def next(self) -> str:
        """The token that was due; the one after it is due then."""
        last = getattr(self, "value", "")
        self.kind, self.value = next(self.tokens, ("end", ""))
        return last

    def take(self, mark: str) -> None:
        if self.value != mark:
            raise ValueError(f"{mark!r} is due, not {self.value!r}")
        self.next()

    def lines(self) -> Iterator[str]:
        while self.kind != "end":
            if self.value.lower() in ("@prefix", "@base", "prefix", "base"):
                self.directive()
            elif self.value == "{" or self.value.upper() == "GRAPH":
                if self.kind == "word":
                    self.next()
                self.block("" if self.value == "{" else self.term())
            else:
                own = self.value != "["
                first = self.term()
                if self.value == "{":
                    self.block(first)
                else:
                    if own or self.value != ".":
                        self.predicates(first)
                    self.take(".")
            yield from self.out
            self.out = []

    def directive(self) -> None:
        dotted, word = self.value[0] == "@", self.next().lower().lstrip("@")
        name = self.next() if word == "prefix" else None
        target = self.resolve(self.next()[1:-1])
        if name is None:
            self.base = target
        else:
            self.prefixes[name[:-1]] = target
        if dotted:
            self.take(".")

    def block(self, graph: str) -> None:
        self.take("{")
        self.graph = graph
        while self.value != "}":
            own = self.value != "["
            first = self.term()
            if own or self.value not in (".", "}"):
                self.predicates(first)
            if self.value == ".":
                self.next()
        self.take("}")
        self.graph = ""

    def say(self, s: str, p: str, o: str) -> None:
        self.out.append(" ".join(x for x in (s, p, o, self.graph, ".") if x))

    def predicates(self, subject: str) -> None:
        while True:
            verb = f"<{T.RDF}type>" if self.value == "a" else None
            verb = self.term() if verb is None else (self.next(), verb)[1]
            self.say(subject, verb, self.term())
            while self.value == ",":
                self.next()
                self.say(subject, verb, self.term())
            while self.value == ";":
                self.next()
            if self.value in (".", "]", "}") or self.kind == "end":
                return

    def resolve(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else urljoin(self.base, iri) if self.base.startswith("http") else self.base + iri

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}gen{self.fresh}"

    def term(self) -> str:
        kind, value = self.kind, self.next()
        if kind == "iri":
            return f"<{self.resolve(value[1:-1])}>"
        if kind == "node":
            return f"_:{self.scope}{value[2:]}"
        if kind == "name":
            prefix, local = value.split(":", 1)
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        if kind == "text":
            return self.literal(value)
        if kind == "number":
            dt = T.DOUBLE if "e" in value.lower() else T.DECIMAL if "." in value else T.INTEGER
            return f'"{value}"^^<{dt}>'
        if value in ("true", "false"):
            return f'"{value}"^^<{T.BOOLEAN}>'
        if value == "<<":
            s, p, o = self.term(), self.term(), self.term()
            self.take(">>")
            return f"<< {s} {p} {o} >>"
        if value == "[":
            node = self.blank()
            if self.value != "]":
                self.predicates(node)
            self.take("]")
            return node
        if value == "(":
            return self.collection()
        raise ValueError(f"no term: {value!r}")

    def literal(self, value: str) -> str:
        size = 3 if value[:3] in ('"""', "'''") and len(value) >= 6 else 1
        body = re.sub(r'\\.|["\n\r]', lambda m: _ESCAPE.get(m[0], m[0]), value[size:-size], flags=re.S)
        if self.kind == "at":
            return f'"{body}"{self.next()}'
        if self.value == "^^":
            self.next()
            return f'"{body}"^^{self.term()}'
        return f'"{body}"'

    def collection(self) -> str:
        items = []
        while self.value != ")":
            items.append(self.term())
        self.take(")")
        nodes = [self.blank() for _ in items] + [f"<{T.RDF}nil>"]
        for i, item in enumerate(items):
            self.say(nodes[i], f"<{T.RDF}first>", item)
            self.say(nodes[i], f"<{T.RDF}rest>", nodes[i + 1])
        return nodes[0]


def _statements(scope: str, base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []  # lines of many small documents, or some of a large one's
        for batch in batches:
            for path, text in batch[["path", "value"]].itertuples(index=False, name=None):
                own = f"{scope}f{hashlib.sha256(path.encode()).hexdigest()[:12]}x"
                for line in _Document(text, own, base).lines():
                    held.append(line)
                    if len(held) == 10_000:
                        yield pd.DataFrame({"value": held})
                        held = []
        yield pd.DataFrame({"value": held}, dtype="string")

    return run


def read_turtle(spark: SparkSession, path: str, *, scope: str = "", base: str = "", graph: T.Const | None = None) -> DataFrame:
    """Quads of Turtle or TriG files; a blank node is one of its file.  ``graph`` takes statements outside of TriG's blocks.

    Anything that is no statement raises.
    """
    return parse_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), scope=scope, base=base, graph=graph)


def parse_documents(documents: DataFrame, *, scope: str = "", base: str = "", graph: T.Const | None = None) -> DataFrame:
    """The same for documents in columns ``path, value``."""
    return parse_lines(documents.mapInPandas(_statements(scope, base), "value string"), graph=graph)


__all__ = ["parse_documents", "read_turtle"]
