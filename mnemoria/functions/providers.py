"""What the engine asks of language models and embedders, and offline defaults that are deterministic."""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from typing import Protocol

import numpy as np

MARK = "$$$$"


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Extractor(Protocol):
    def extract(self, chunk: str, limit: int) -> str:
        """Lines ("entity"$$$$name$$$$type$$$$description$$$$aliases) and ("relationship"$$$$source$$$$target$$$$relation$$$$description$$$$from$$$$until)."""


class Answerer(Protocol):
    def answer(self, question: str, context: str) -> tuple[str, float]: ...


class HashingEmbedder:
    """Signed hashed words and their trigrams, of unit length; blank texts have none."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def one(self, text: str) -> list[float] | None:
        v = np.zeros(self.dimensions)
        for w in re.findall(r"\w+", text.lower()):
            for f in (w, *(f"{w[i : i + 3]}*" for i in range(len(w) - 2))):
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        n = float(np.linalg.norm(v))
        return (v / n).astype(np.float32).tolist() if n else None

    def embed(self, texts: list[str | None]) -> list[list[float] | None]:
        return [self.one(t.replace("\n", " ")) if t and t.strip() else None for t in texts]


class RuleExtractor:
    """Capitalised phrases are entities; two of one sentence are related by the words between them."""

    NAME = re.compile(r"\b([A-Z][\w-]+(?:\s+[A-Z][\w-]+)*)\b")

    def extract(self, chunk: str, limit: int = 40) -> str:
        seen: dict[str, str] = {}
        relations = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n", chunk):
            names = [m for m in self.NAME.finditer(sentence) if len(m[1]) > 2 and m[1].lower() not in ("the", "and", "for")]
            for m in names:
                seen.setdefault(m[1], sentence.strip())
            for a, b in zip(names, names[1:]):
                words = re.findall(r"\w+", sentence[a.end() : b.start()])[:4]
                if words and a[1] != b[1]:
                    years = re.findall(r"\b(?:1[0-9]|20)\d\d\b", sentence)
                    relations.append((a[1], b[1], "_".join(words).lower(), sentence.strip(), years[0] if years else "none", years[1] if len(years) > 1 else "none"))
        lines = [f'("entity"{MARK}{n}{MARK}Entity{MARK}{d}{MARK}none)' for n, d in seen.items()]
        lines += ["(" + MARK.join(('"relationship"', *r)) + ")" for r in relations[:limit]]
        return "\n".join(lines)


class ExtractiveAnswerer:
    """The context line that shares most words with the question; 0.7 sure, or nothing."""

    def answer(self, question: str, context: str) -> tuple[str, float]:
        asked = set(re.findall(r"\w+", question.lower()))
        lines = [x for x in context.split("\n") if x.strip() and not x.startswith("#")]
        best = max(lines, key=lambda x: (len(asked & set(re.findall(r"\w+", x.lower()))), -len(x)), default=None)
        return (best.strip(), 0.7) if best else ("No relevant information found.", 0.0)


class RateLimiter:
    """At most ``limit`` calls in any 60 seconds; a task has the cluster's limit over the number of tasks."""

    def __init__(self, limit: int, clock=time.monotonic, sleep=time.sleep):
        self.limit, self.clock, self.sleep, self.calls = limit, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= 60:
            self.calls.popleft()
        if len(self.calls) >= self.limit:
            self.sleep(60 - (now - self.calls[0]))
            self.calls.popleft()
        self.calls.append(self.clock())


def retrying(fn, tries: int = 3, delay: float = 0.0):
    """fn called again after a failure, ``delay * 2**n`` seconds later; the last failure is raised."""

    def call(*args):
        for n in range(tries):
            try:
                return fn(*args)
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(delay * 2**n)

    return call
