"""Stand-ins for the model calls, deterministic and Arrow-batched; a real model takes their place by the same signature.

Each is a function of texts; ``column`` wraps one as a pandas UDF. Equal inputs give equal
outputs, so callers drop duplicates first and join the answers back (``once``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
_WORD = re.compile(r"[^\W_]+")
_NOT = re.compile(r"(?i)\b(not|no|never|none|without|cannot)\b|n't\b")


def embedding(text: str | None) -> list[float]:
    """UDF3: the code of each of the first 384 UTF-16 units modulo 100, as hundredths."""
    units = np.frombuffer((text or "").encode("utf-16-le"), "<u2")[:DIM]
    return np.pad(units % 100 / 100.0, (0, DIM - len(units))).tolist()


def nli(premise: str | None, hypothesis: str | None) -> tuple[float, float, float]:
    """UDF2: (entailment, neutral, contradiction): the share of the hypothesis' words that the premise has; a difference in negation turns it."""
    p, h = set(_WORD.findall((premise or "").lower())), set(_WORD.findall((hypothesis or "").lower()))
    share = len(p & h) / len(h) if h else 0.0
    turned = bool(_NOT.search(premise or "")) != bool(_NOT.search(hypothesis or ""))
    strong = round(share**2, 6)
    return (0.0, round(1 - strong, 6), strong) if turned else (strong, round(1 - strong, 6), 0.0)


def relevance(query: str | None, passage: str | None) -> float:
    """UDF4: the share of the query's words in the passage, damped by the passage's length."""
    q, p = set(_WORD.findall((query or "").lower())), _WORD.findall((passage or "").lower())
    return round(len(q & set(p)) / max(1, len(q)) - len(p) / 1e4, 6)


def answer(question: str | None, passage: str | None) -> str:
    """UDF5: the sentence of the passage with most of the question's words; the first of equals."""
    return max(re.split(r"(?<=[.!?])\s+", passage or ""), key=lambda s: relevance(question, s))


def grounded(document: str | None, claim: str | None) -> tuple[bool, float]:
    """UDF5: whether the document supports the claim, and how surely."""
    e, _, c = nli(document, claim)
    return e > c and e >= 0.5, round(max(e, c, 1 - e - c), 6)


def sentences(text: str | None, most: int = 20) -> list[str]:
    """UDF6: a text's statements, one a sentence, without those under three words."""
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text or "")) if len(s.split()) > 2][:most]


def triples(text: str | None, most: int = 10) -> list[tuple[str, str, str]]:
    """UDF6: (subject, predicate, object) of each statement: its first word, its second, the rest."""
    return [tuple(s.rstrip(".!?").split(None, 2)) for s in sentences(text, most)]


def call(system: str | None, user: str | None) -> str:
    """UDF1: the user's statements as JSON."""
    return json.dumps({"entries": [{"title": s[:120], "content": s} for s in sentences(user)]}, ensure_ascii=False)


class Breaker:
    """Stops calling what keeps failing: after ``failures`` in a row calls are refused for ``pause_s``."""

    def __init__(self, function: Callable, failures: int = 5, pause_s: float = 120, clock: Callable[[], float] | None = None):
        import time

        self.function, self.most, self.pause, self.clock = function, failures, pause_s, clock or time.monotonic
        self.failed, self.open_until = 0, float("-inf")

    def __call__(self, *args):
        if self.clock() < self.open_until:
            raise RuntimeError("the model is paused")
        try:
            out = self.function(*args)
        except Exception:
            self.failed += 1
            if self.failed >= self.most:
                self.open_until, self.failed = self.clock() + self.pause, 0
            raise
        self.failed = 0
        return out


TYPES = {
    embedding: "array<double>", nli: "struct<entailment:double,neutral:double,contradiction:double>", relevance: "double", answer: "string", grounded: "struct<supported:boolean,confidence:double>",
    sentences: "array<string>", triples: "array<struct<subject:string,predicate:string,object:string>>", call: "string",
}


def column(model: Callable, *inputs: Column | str) -> Column:
    """A stand-in over columns, a pandas UDF."""
    kind = TYPES[model]
    names = re.findall(r"(\w+):", kind) if kind.startswith("struct") else None

    def run(first, *rest):
        out = [model(*x) for x in zip(first, *rest, strict=True)]
        return pd.DataFrame(out, columns=names) if names else pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*inputs)


def once(df: DataFrame, model: Callable, name: str, *inputs: str) -> DataFrame:
    """STR9: df with the model's answer, which is asked once for each different input."""
    asked = df.select(*inputs).distinct().withColumn(name, column(model, *inputs))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in inputs]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.alias("l").join(asked.alias("r"), on).select("l.*", f"r.{name}")
