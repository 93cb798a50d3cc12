"""One interface for tokens of prose and code, and a table function of it for SQL.

    register(spark)
    spark.sql("SELECT * FROM tokenize(TABLE(SELECT doc_id, text FROM documents), kind => 'prose')")

The result has the table's columns but its text, then pos (from 0), token and line (from 1), a row for each token. kind is a name of
TOKENIZERS, or 'path': then the column path tells by its extension, and files of other kinds give no rows. With first => true there is a column
first besides: whether the token stands in the text for the first time, so different tokens are counted without a move of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from sievemark import params as P
from sievemark.functions.code_tokens import parse


class Tokenizer(Protocol):
    def tokens(self, text: str) -> Iterator[tuple[str, int]]:
        """Tokens of a text with their lines, in order."""


class Prose:
    """Runs of letters and digits, in lower case: as fingerprints.words()."""

    word = regex.compile(r"[\p{L}\p{N}]+")

    def tokens(self, text: str) -> Iterator[tuple[str, int]]:
        for line, x in enumerate(text.lower().split("\n"), 1):
            yield from ((t, line) for t in self.word.findall(x))


@dataclass(frozen=True)
class Code:
    """Token classes of source text: as archives.tokenised_sources()."""

    java: bool

    def tokens(self, text: str) -> Iterator[tuple[str, int]]:
        return iter(parse(text, self.java)[0])


TOKENIZERS: dict[str, Tokenizer] = {"prose": Prose(), "java": Code(True), "cpp": Code(False)}


def of_path(path: str | None) -> Tokenizer | None:
    extension = os.path.splitext(path or "")[1]
    return TOKENIZERS["java"] if extension in P.JAVA_EXTENSIONS else TOKENIZERS["cpp"] if extension in P.C_EXTENSIONS else None


@dataclass
class _Result(AnalyzeResult):
    columns: tuple[str, ...] = ()
    text: str = "text"
    kind: str = "prose"
    first: bool = False


@udtf
class Tokenize:
    """tokenize(TABLE(...), kind => 'prose', text => 'text', first => false)."""

    def __init__(self, result: _Result):
        self.columns, self.text, self.kind, self.first = result.columns, result.text, result.kind, result.first

    @staticmethod
    def analyze(rows: AnalyzeArgument, kind: AnalyzeArgument, text: AnalyzeArgument | None = None, first: AnalyzeArgument | None = None) -> _Result:
        if not rows.isTable:
            raise ValueError("the first argument of tokenize is a table")
        name = text.value if text is not None else "text"
        if kind.value not in (*TOKENIZERS, "path"):
            raise ValueError(f"kind is one of {', '.join(TOKENIZERS)} or path")
        names = rows.dataType.names
        if name not in names or (kind.value == "path" and "path" not in names):
            raise ValueError(f"the table has no column {name}" if name not in names else "the table has no column path")
        kept = [f for f in rows.dataType.fields if f.name != name]
        more = [T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("line", T.IntegerType())]
        marked = first is not None and bool(first.value)
        if marked:
            more.append(T.StructField("first", T.BooleanType()))
        return _Result(T.StructType([*kept, *more]), columns=tuple(f.name for f in kept), text=name, kind=kind.value, first=marked)

    def eval(self, rows: Row, kind: str, text: str = "text", first: bool = False) -> Iterator[tuple]:
        tokenizer = of_path(rows["path"]) if self.kind == "path" else TOKENIZERS[self.kind]
        if tokenizer is not None:
            own = tuple(rows[c] for c in self.columns)
            seen: set[str] = set()
            for pos, (token, line) in enumerate(tokenizer.tokens(rows[self.text] or "")):
                if self.first:
                    yield (*own, pos, token, line, token not in seen)
                    seen.add(token)
                else:
                    yield (*own, pos, token, line)


def register(spark: SparkSession) -> None:
    spark.udtf.register("tokenize", Tokenize)
